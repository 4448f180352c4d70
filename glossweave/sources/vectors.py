"""Word-vector text (header, then ``concept v1 … vd``) to unit vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import concept_parts
from ..operators.ranking import first_per, global_index
from ..operators.vectors import norm
from ..schemas import conform
from ..session import reliable_cut
from .common import Built, allowed, counter_rows, intern
from .interning import resolve
from .text import read_lines

_PLACE = ["file", "block", "at"]


def build_vectors(spark: SparkSession, path: str, languages: list[str] | None = None) -> Built:
    return load_vectors(read_lines(spark, path), languages)


def load_vectors(lines: DataFrame, languages: list[str] | None = None) -> Built:
    """Unit vectors of ``lines(line, file, block, at)`` with dense ids in file order; the first row of a repeated concept wins.

    Rows of a wrong size, with non-finite numbers, of zero length or with a malformed
    concept are counted as malformed; every row of the header's count is accounted for.
    """
    lines = reliable_cut(lines)
    header = lines.orderBy(*_PLACE).limit(1).collect()
    if not header:
        raise ValueError("vector source is empty")
    sizes = header[0]["line"].split()
    if len(sizes) != 2 or not all(s.isdigit() and int(s) > 0 for s in sizes):
        raise ValueError("vector header must hold positive row and dimension counts")
    expected, dimensions = map(int, sizes)
    place = F.struct(*_PLACE)
    first = F.struct(*[F.lit(header[0][c]).alias(c) for c in _PLACE])
    body = lines.filter(place != first)

    concept = F.substring_index("line", " ", 1)
    numbers = F.trim(F.expr("substring(line, instr(line, ' ') + 1)"))
    values = F.transform(F.split(numbers, r"\s+"), lambda x: x.try_cast("float"))
    language, term = concept_parts(F.col("concept"), strict=False)
    broken = F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    rows = (
        body.withColumn("concept", concept)
        .withColumn("embedding", F.when(F.contains("line", F.lit(" ")), values))
        .withColumn("language", language)
        .withColumn("term", term)
        .withColumn("kept", allowed(F.col("language"), languages))
    )
    sound = F.col("embedding").isNotNull() & (F.size("embedding") == dimensions) & ~broken
    state = (
        F.when(F.col("term").isNull() | F.col("embedding").isNull(), "malformed")
        .when(~F.col("kept"), "filtered")
        .when(~F.coalesce(sound, F.lit(False)), "malformed")
        .when(norm(F.col("embedding")) == 0, "malformed")
        .otherwise("valid")
    )
    judged = rows.withColumn("state", state)
    unique = first_per(judged.filter("state = 'valid'"), ["concept"], _PLACE)
    length = norm(F.col("embedding"))
    scaled = F.transform("embedding", lambda x: (x / length).cast("float"))
    numbered = global_index(
        unique.select(*_PLACE, "concept", "language", "term", scaled.alias("embedding")), _PLACE, "semantic_id"
    )
    terms, ids = resolve(intern(numbered))
    vectors = conform(
        numbered.withColumn("term_id", ids.of(F.col("language"), F.col("term"))), "vectors"
    )
    count = lambda name: F.count(F.when(F.col("state") == name, 1))
    counters = counter_rows(
        judged,
        expected_rows=F.lit(expected) + F.count(F.lit(None)),
        dimensions=F.lit(dimensions) + F.count(F.lit(None)),
        malformed=count("malformed"),
        filtered=count("filtered"),
        valid=count("valid"),
    ).unionByName(counter_rows(vectors, terms=F.count(F.lit(1))))
    totals = counters.groupBy().pivot("metric", ["expected_rows", "terms", "malformed", "filtered", "valid"]).agg(
        F.sum("observed")
    )
    extra = totals.select(
        F.inline(
            F.array(
                F.struct(F.lit("duplicates").alias("metric"), (F.col("valid") - F.col("terms")).alias("observed")),
                F.struct(
                    F.lit("unaccounted").alias("metric"),
                    (F.col("expected_rows") - F.col("valid") - F.col("malformed") - F.col("filtered")).alias("observed"),
                ),
            )
        )
    )
    return Built({"terms": terms, "vectors": vectors}, counters.unionByName(extra), ids)
