"""Knowledge-graph assertions (tab-separated) to relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import concept_parts
from ..schemas import DIRECTION_CODES, RELATION_CODES, conform
from ..session import written
from .common import CONCEPTNET, Built, allowed, counter_rows, intern
from .interning import resolve
from .text import read_lines

# --- fixed values: predicate -> (relation, direction) ---------------------------
PREDICATES = {
    "Synonym": ("synonym", "symmetric"),
    "Antonym": ("antonym", "symmetric"),
    "IsA": ("hypernym", "outbound"),
    "PartOf": ("holonym", "outbound"),
    "HasA": ("meronym", "outbound"),
    "DerivedFrom": ("derived_from", "outbound"),
    "EtymologicallyRelatedTo": ("etymologically_related", "symmetric"),
    "UsedFor": ("used_for", "outbound"),
    "CapableOf": ("capable_of", "outbound"),
    "AtLocation": ("at_location", "outbound"),
    "RelatedTo": ("related", "symmetric"),
    "SimilarTo": ("related", "symmetric"),
}
# --- end of fixed values -------------------------------------------------------


def build_conceptnet(spark: SparkSession, paths: str | list[str], languages: list[str] | None = None) -> Built:
    return load_conceptnet(read_lines(spark, paths), languages)


def load_conceptnet(lines: DataFrame, languages: list[str] | None = None) -> Built:
    """One forward relation per accepted assertion; repeats collapse on the unique key."""
    relation_of = F.create_map(*[F.lit(x) for k, (r, _) in PREDICATES.items() for x in (k, RELATION_CODES[r])])
    direction_of = F.create_map(*[F.lit(x) for k, (_, d) in PREDICATES.items() for x in (k, DIRECTION_CODES[d])])
    field = lambda i: F.get("fields", F.lit(i))
    rows = lines.filter(F.col("line") != "").select(F.split("line", "\t", 5).alias("fields"))
    s_language, s_term = concept_parts(field(2))
    t_language, t_term = concept_parts(field(3))
    predicate = F.regexp_extract(field(1), "([^/]*)$", 1)
    # an unreadable weight does not count against an assertion
    weight = F.get_json_object(field(4), "$.weight").try_cast("double")
    parsed = rows.select(
        (F.size("fields") >= 4).alias("shaped"),
        F.try_element_at(relation_of, predicate).alias("relation_code"),
        F.try_element_at(direction_of, predicate).alias("direction_code"),
        s_language.alias("s_language"), s_term.alias("s_term"),
        t_language.alias("t_language"), t_term.alias("t_term"),
        F.coalesce(weight <= 0, F.lit(False)).alias("worthless"),
    )
    usable = (
        F.col("shaped")
        & F.col("relation_code").isNotNull()
        & F.col("s_term").isNotNull()
        & F.col("t_term").isNotNull()
        & allowed(F.col("s_language"), languages)
        & allowed(F.col("t_language"), languages)
        & ~F.col("worthless")
    )
    # parsed once, read for terms, relations and counters
    judged = written(parsed.withColumn("accepted", F.coalesce(usable, F.lit(False))), "judged")
    accepted = judged.filter("accepted")
    terms, ids = resolve(intern(
        accepted.select(F.col("s_language").alias("language"), F.col("s_term").alias("term")),
        accepted.select(F.col("t_language").alias("language"), F.col("t_term").alias("term")),
    ))
    none = F.lit(None)
    relations = conform(
        accepted.select(
            ids.of(F.col("s_language"), F.col("s_term")).alias("source_term_id"), none.alias("source_sense_id"),
            "relation_code", ids.of(F.col("t_language"), F.col("t_term")).alias("target_term_id"),
            none.alias("target_sense_id"), "direction_code", F.lit(CONCEPTNET).alias("provenance_id"),
        ),
        "relations",
    ).dropDuplicates()
    count = lambda condition: F.count(F.when(condition, 1))
    counters = counter_rows(
        judged,
        source_assertions=count(F.col("shaped")),
        assertions=count(F.col("accepted")),
        skipped=count(F.col("shaped") & ~F.col("accepted")),
        malformed=count(~F.col("shaped")),
    ).unionByName(counter_rows(relations, relations=F.count(F.lit(1))))
    return Built({"terms": terms, "relations": relations}, counters, ids)
