"""What the corpus builders share: interning, provenance ids, the refresh sink."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F

from ..functions.ids import term_id
from ..functions.text import full_key, is_simple, lookup_key, simple_key
from ..schemas import TABLES, conform
from .interning import TermIds, resolve

# --- fixed values: provenance of the public corpora ---------------------------
PROVENANCE = [
    (1, "Open English WordNet", "CC-BY-4.0", "https://en-word.net/"),
    (2, "Wiktionary", "CC-BY-SA-4.0 and GFDL-1.3-or-later", "https://kaikki.org/dictionary/"),
    (3, "ConceptNet 5.7", "CC-BY-SA-4.0", "https://conceptnet.io/"),
    (4, "ConceptNet Numberbatch 19.08", "CC-BY-SA-4.0", "https://github.com/commonsense/conceptnet-numberbatch"),
    (5, "CMUdict", "BSD-2-Clause-style", "https://github.com/cmusphinx/cmudict"),
]
# --- end of fixed values -------------------------------------------------------
WORDNET, WIKTIONARY, CONCEPTNET, VECTORS, CMUDICT = (row[0] for row in PROVENANCE)


@dataclass
class Built:
    """Tables of one source plus its counters (metric, observed).

    A source whose relations know what their ends are called has them once more as
    ``named_relations``, with source_term and target_term.
    """

    tables: dict[str, DataFrame] = field(default_factory=dict)
    counters: DataFrame | None = None
    ids: TermIds = field(default_factory=TermIds)
    named_relations: DataFrame | None = None


def provenance_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVENANCE, TABLES["provenance"])


def term_key(language: Column, term: Column) -> Column:
    """Id of a term by its content alone; equals the id in a terms table in which no hash is shared."""
    return term_id(language, lookup_key(term), term)


def intern(*names: DataFrame) -> DataFrame:
    """terms out of (language, term) mentions; each distinct mention is normalised once.

    Terms that need the Python function are a branch of their own: adaptive execution
    drops it, workers and all, when its input turns out to be empty.
    """
    mentions = reduce(DataFrame.unionByName, [n.select("language", "term") for n in names])
    term = F.col("term")
    plain = mentions.filter(is_simple(term)).distinct()
    other = mentions.filter(~is_simple(term)).distinct()
    keyed = plain.withColumn("normalized_term", simple_key(term)).unionByName(
        other.withColumn("normalized_term", full_key(term))
    )
    rows = keyed.withColumn("term_id", term_id("language", "normalized_term", "term"))
    return conform(rows, "terms")


def merge_terms(*tables: DataFrame) -> DataFrame:
    """One terms table from several sources: equal content has one row, unlike terms have unlike ids."""
    return resolve(reduce(DataFrame.unionByName, tables))[0]


def id_collisions(terms: DataFrame) -> DataFrame:
    """Ids that stand for more than one term; must be empty."""
    return terms.groupBy("term_id").agg(F.count(F.lit(1)).alias("terms")).filter("terms > 1")


def counter_rows(table: DataFrame, **counts: Column) -> DataFrame:
    """(metric, observed) of several aggregates over one table, in one pass."""
    row = table.agg(*[value.cast("bigint").alias(metric) for metric, value in counts.items()])
    metrics = [F.struct(F.lit(metric).alias("metric"), F.col(metric).alias("observed")) for metric in counts]
    return row.select(F.inline(F.array(*metrics)))


def table_counts(**counts: DataFrame | tuple[DataFrame, Column]) -> DataFrame:
    """(metric, observed) of the rows of several tables, or of an aggregate over one."""
    parts = []
    for metric, what in counts.items():
        table, value = what if isinstance(what, tuple) else (what, F.count(F.lit(1)))
        parts.append(counter_rows(table, **{metric: value}))
    return reduce(DataFrame.unionByName, parts)


def allowed(column: Column, languages: list[str] | None) -> Column:
    return F.lit(True) if languages is None else column.isin(languages)


def by_key(df: DataFrame, key: str, rows_per_file: int) -> DataFrameWriter:
    """A writer of one folder per ``key``, with at most ``rows_per_file`` rows a file.

    Rows are moved once, and not counted first: adaptive execution splits the partitions that
    turn out large, so a language with a third of all rows is written by many tasks.
    """
    spread = df.hint("rebalance", F.col(key))
    return spread.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(key)


def refresh_source(table: DataFrame, path: str, rows_per_file: int = 4_000_000) -> None:
    """Replace only the sources present in ``table``; other sources' rows stay as they are.

    The table is laid out by ``provenance_id``, so running a source again is idempotent.
    """
    by_key(table, "provenance_id", rows_per_file).option("partitionOverwriteMode", "dynamic").parquet(path)
