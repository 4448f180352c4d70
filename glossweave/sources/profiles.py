"""Row counts, malformed rows and layout-independent digests of the source files.

Each source has one canonical text per logical row; formatting, key order, file layout
and compression do not change its digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import compatibility_text, squeeze
from ..plans.quality import source_profile
from .text import read_lines
from .wordnet import ENTRY_SCHEMA, SYNSET_SCHEMA, elements


def profile_wordnet(spark: SparkSession, path: str) -> DataFrame:
    """Entries and synsets as JSON of their declared fields, in NFKC with collapsed spaces."""

    def rows(tag: str, schema: str) -> DataFrame:
        parsed = elements(spark, path, tag, schema)
        fields = F.to_json(F.struct(*[F.col(c) for c in sorted(parsed.columns)]))
        return parsed.select(F.concat_ws("\t", F.lit(tag), compatibility_text(fields)).alias("row"))

    both = rows("LexicalEntry", ENTRY_SCHEMA).unionByName(rows("Synset", SYNSET_SCHEMA))
    return source_profile(both, "wordnet", F.col("row"), F.lit(False))


def profile_wiktionary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON objects with sorted keys and no formatting; anything else is malformed."""
    lines = read_lines(spark, paths).filter(F.trim("line") != "")
    value = lines.select(F.try_parse_json("line").alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return source_profile(value, "wiktionary", F.to_json("v"), ~is_object)


def profile_conceptnet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = read_lines(spark, paths).filter(F.col("line") != "")
    return source_profile(lines, "conceptnet", F.col("line"), F.size(F.split("line", "\t")) < 4)


def profile_vectors(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """Rows with ``dimensions`` finite numbers; the header (two numbers) is left out."""
    lines = read_lines(spark, path).select(squeeze(F.col("line")).alias("line")).filter(
        (F.col("line") != "") & ~F.col("line").rlike(r"^\d+ \d+$")
    )
    tokens = F.split("line", " ")
    unreal = F.exists(F.slice(tokens, 2, dimensions), lambda t: F.lower(t).rlike(r"^[+-]?(nan|inf)$"))
    return source_profile(lines, "vectors", F.col("line"), (F.size(tokens) != dimensions + 1) | unreal)


def profile_cmudict(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = read_lines(spark, paths).select(squeeze(F.col("line")).alias("line")).filter(
        (F.col("line") != "") & ~F.col("line").startswith(";;;") & ~F.col("line").startswith("#")
    )
    return source_profile(lines, "cmudict", F.col("line"), ~F.contains("line", F.lit(" ")))
