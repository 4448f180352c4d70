"""Pronouncing dictionary to spoken pronunciations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.phonetics import rhyme_key
from ..functions.text import squeeze
from ..schemas import conform
from .common import Built, counter_rows, intern
from .interning import resolve
from .text import read_lines


def build_cmudict(spark: SparkSession, paths: str | list[str]) -> Built:
    return load_cmudict(read_lines(spark, paths))


def load_cmudict(lines: DataFrame) -> Built:
    """English terms with phonemes and rhyme keys; variant marks such as ``(2)`` are dropped."""
    lines = lines.select(squeeze(F.col("line")).alias("line")).filter(
        (F.col("line") != "") & ~F.col("line").startswith(";;;") & ~F.col("line").startswith("#")
    )
    rows = lines.select(
        F.replace(
            F.regexp_replace(F.substring_index("line", " ", 1), r"\(\d+\)$", ""), F.lit("_"), F.lit(" ")
        ).alias("term"),
        F.upper(F.regexp_extract("line", r"^\S+ (.*)$", 1)).alias("phonemes"),
        F.lit("en").alias("language"),
    )
    good = rows.filter(F.col("phonemes") != "")
    terms, ids = resolve(intern(good))
    spoken = conform(
        good.select(
            ids.of(F.col("language"), F.col("term")).alias("term_id"), "phonemes",
            rhyme_key(F.col("phonemes")).alias("rhyme_key"),
        ),
        "spoken",
    ).dropDuplicates(["term_id", "phonemes"])
    heard = F.count(F.when(F.col("phonemes") != "", 1))
    counters = counter_rows(
        rows, entries=heard, pronunciations=heard, malformed=F.count(F.when(F.col("phonemes") == "", 1))
    )
    return Built({"terms": terms, "spoken": spoken}, counters, ids)
