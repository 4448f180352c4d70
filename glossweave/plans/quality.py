"""Checks between jobs: digests, floors, and partition-versus-whole comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import hash60, summed_digest
from ..operators.graph import anchored_edges, scan_order
from ..operators.ranking import top_k
from ..schemas import MAX_BUDGET, OWNER_PROVENANCE, RELATION_CODES, Corpus
from ..session import written
from .layout import resolve_in_partition

# --- fixed values: least rows a complete build must have ----------------------
FULL_FLOORS = {
    "wordnet": {"synsets": 100_000, "senses": 180_000},
    "wiktionary": {
        "entries": 10_000_000,
        "senses": 12_000_000,
        "translations": 3_000_000,
        "synonyms": 3_500_000,
        "pronunciations": 6_000_000,
        "language_codes": 4_000,
    },
    "conceptnet": {
        "source_assertions": 20_000_000,
        "assertions": 18_000_000,
        "relations": 17_500_000,
    },
    "vectors": {"expected_rows": 9_000_000, "terms": 9_000_000},
    "cmudict": {"entries": 130_000},
}
ENGLISH_FLOORS = {
    "wordnet": {"synsets": 100_000, "senses": 180_000},
    "wiktionary": {"entries": 1_400_000, "senses": 1_900_000, "language_codes": 1},
    "conceptnet": {"assertions": 1_000_000, "relations": 1_000_000},
    "vectors": {"terms": 500_000},
    "cmudict": {"entries": 130_000},
}
# --- end of fixed values -------------------------------------------------------


def source_profile(rows: DataFrame, source: str, text: Column, malformed: Column) -> DataFrame:
    """One row: well-formed rows, malformed rows, and a digest of the well-formed ones.

    The digest is a sum of per-row hashes: it does not depend on file layout or row
    order, so it needs one pass and no ordering.
    """
    bad = F.coalesce(malformed, F.lit(False))
    good_text = F.when(~bad, text)
    return rows.select(good_text.alias("t"), bad.alias("bad")).agg(
        F.lit(source).alias("source"),
        F.count(F.when(~F.col("bad"), 1)).alias("row_count"),
        F.count(F.when(F.col("bad"), 1)).alias("malformed"),
        summed_digest(F.when(~F.col("bad"), F.col("t"))).alias("row_digest"),
    )


def verify_sources(profiles: DataFrame, lock: DataFrame) -> DataFrame:
    """Sources whose profile differs from the locked one (or that only one side knows)."""
    fields = ["row_count", "malformed", "row_digest"]
    both = profiles.alias("p").join(lock.alias("l"), "source", "full_outer")
    equal = F.lit(True)
    for name in fields:
        equal = equal & F.col(f"p.{name}").eqNullSafe(F.col(f"l.{name}"))
    return both.filter(~equal).select(
        "source", *[F.col(f"p.{n}").alias(f"observed_{n}") for n in fields],
        *[F.col(f"l.{n}").alias(f"locked_{n}") for n in fields],
    )


def stage_counts(corpus: Corpus) -> DataFrame:
    """Rows of every table per provenance: (provenance_id, metric, observed).

    Child tables that tell their entry's provenance are counted as they are read. Others are
    counted per parent first and then carried up, so the joins move one row per parent.
    """
    entry_source = corpus.entries.select("entry_id", "provenance_id")
    sense_source = corpus.senses.select("sense_id", "entry_id").join(entry_source, "entry_id")
    counted = [
        corpus.entries.groupBy("provenance_id").agg(F.count(F.lit(1)).alias("observed")).withColumn(
            "metric", F.lit("entries")
        ),
    ]
    for name, parents, key in (
        ("senses", entry_source, "entry_id"),
        ("examples", sense_source.select("sense_id", "provenance_id"), "sense_id"),
        ("pronunciations", entry_source, "entry_id"),
    ):
        if corpus.has(name):
            rows = getattr(corpus, name)
            if OWNER_PROVENANCE in rows.columns:
                per_parent = rows.filter(F.col(key).isNotNull()).groupBy(
                    F.col(OWNER_PROVENANCE).alias("provenance_id")
                ).agg(F.count(F.lit(1)).alias("n"))
            else:
                per_parent = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(parents, key)
            counted.append(
                per_parent.groupBy("provenance_id").agg(F.sum("n").alias("observed")).withColumn("metric", F.lit(name))
            )
    for name in ("translations", "synonyms", "relations"):
        if corpus.has(name):
            counted.append(
                getattr(corpus, name).groupBy("provenance_id").agg(F.count(F.lit(1)).alias("observed"))
                .withColumn("metric", F.lit(name))
            )
    result = counted[0]
    for part in counted[1:]:
        result = result.unionByName(part)
    return result.select("provenance_id", "metric", "observed")


def floors_table(spark, floors: Mapping[str, Mapping[str, int]]) -> DataFrame:
    rows = [(s, m, n) for s, metrics in floors.items() for m, n in metrics.items()]
    return spark.createDataFrame(rows, "stage string, metric string, minimum bigint")


def floor_report(metrics: DataFrame, floors: DataFrame) -> DataFrame:
    """Observed counts against floors; a metric that was never reported counts as -1."""
    observed = F.coalesce("observed", F.lit(-1).cast("bigint"))
    return floors.join(metrics.select("stage", "metric", "observed"), ["stage", "metric"], "left").select(
        "stage", "metric", observed.alias("observed"), "minimum", (observed >= F.col("minimum")).alias("passed")
    )


def sample_words(corpus: Corpus, words: int, seed: int) -> DataFrame:
    """Words per language to compare: the half with most senses and a seeded spread.

    The spread is the hash order of (seed, term id): the same words on every run.
    """
    if words < 2:
        raise ValueError("at least 2 words")
    counted = corpus.terms.join(corpus.term_counts, "term_id")
    half = words // 2
    rich = top_k(
        counted.filter(F.col("sense_count") > 0), ["language"],
        [F.desc("sense_count"), "term_id"], half, rank="__at",
    )
    spread = top_k(
        counted.withColumn("__draw", hash60(F.lit(seed), F.col("term_id"))), ["language"],
        ["__draw", "term_id"], words - half, rank="__at",
    )
    keep = ["language", F.col("normalized_term").alias("word")]
    return rich.select(*keep).unionByName(spread.select(*keep)).distinct()


def compare_ranked(
    questions: DataFrame, expected: DataFrame, actual: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Per question: are two ranked answers equal row by row? ``rank`` joins the keys."""
    on = [*keys, "rank"]
    left = expected.select(*on, F.struct(*values).alias("__expected"))
    right = actual.select(*on, F.struct(*values).alias("__actual"))
    wrong = (
        left.join(right, on, "full_outer")
        .filter(~F.col("__expected").eqNullSafe(F.col("__actual")))
        .groupBy(*keys)
        .agg(F.min("rank").alias("first_difference"))
    )
    return questions.select(*keys).distinct().join(wrong, list(keys), "left").withColumn(
        "divergent", F.col("first_difference").isNotNull()
    )


def _around(
    corpus: Corpus, tables: dict[str, DataFrame], sampled: DataFrame
) -> tuple[Corpus, dict[str, DataFrame]]:
    """Corpus and partitions cut to the sampled words and to what these point to.

    Every cut is written: the next join then knows how few rows it looks for, and the tables
    are filtered where they lie instead of being shuffled.
    """
    asked = sampled.withColumnRenamed("word", "normalized_term")
    words = written(corpus.terms.join(asked, ["normalized_term", "language"]).select("term_id", "pack_id"), "words")
    sources = words.withColumnRenamed("term_id", "source_term_id")
    relations = [
        written(table.join(sources.select(*on), on, "left_semi"), "relations")
        for table, on in (
            (corpus.relations, ["source_term_id"]), (tables["relations"], ["source_term_id", "pack_id"])
        )
    ]

    def senses_of(terms: DataFrame, source: Corpus | dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        entries, senses = (source[n] if isinstance(source, dict) else getattr(source, n) for n in ("entries", "senses"))
        entries = written(entries.join(terms.select("term_id").distinct(), "term_id", "left_semi"), "entries")
        return entries, written(senses.join(entries.select("entry_id"), "entry_id", "left_semi"), "senses")

    translations = [
        written(links.join(senses_of(words, source)[1].select("sense_id"), "sense_id", "left_semi"), "translations")
        for links, source in ((corpus.translations, corpus), (tables["translations"], tables))
    ]
    ids = words.select("term_id")
    for edges in (*relations, *translations):
        ids = ids.union(edges.select("target_term_id"))
    ids = written(ids.distinct(), "ids")
    kept = lambda table, name: written(table.join(ids, "term_id", "left_semi"), name)
    whole, parts = senses_of(ids, corpus), senses_of(ids, tables)
    near = Corpus(
        terms=kept(corpus.terms, "terms"), term_counts=kept(corpus.term_counts, "term_counts"), entries=whole[0],
        senses=whole[1], relations=relations[0], translations=translations[0],
    )
    return near, {
        "terms": kept(tables["terms"], "terms"), "entries": parts[0], "senses": parts[1], "relations": relations[1],
        "translations": translations[1], "target_catalogue": kept(tables["target_catalogue"], "target_catalogue"),
    }


def differential_check(
    corpus: Corpus, tables: dict[str, DataFrame], plan: DataFrame, words: int = 200, limit: int = 25,
    seed: int = 20260816,
) -> DataFrame:
    """Whole-corpus answers against each language's partition, for sampled words.

    (kind, language, word, relation_code, item, divergent, first_difference) per question:
    all 12 relations, the senses, and the translations of the first three senses.
    """
    sampled = sample_words(corpus, words, seed).join(plan.select("language", "pack_id"), "language")
    # a bounded number of words per language, read by everything below
    sampled = written(sampled, "sampled")
    corpus, tables = _around(corpus, tables, sampled)
    parts = Corpus(**{k: v for k, v in tables.items() if k != "target_catalogue"})
    scans = sampled.withColumn(
        "relation_code", F.explode(F.array(*[F.lit(c) for c in RELATION_CODES.values()]))
    ).withColumn("target_language_filter", F.lit(None).cast("string")).withColumn(
        "sense_filter", F.lit(None).cast("string")
    )
    keys = ["language", "word", "relation_code"]
    values = ["target_term", "target_language", "target_entry_count", "target_sense_count", "target_variant_rank"]

    def first_rows(edges: DataFrame) -> DataFrame:
        forward = edges.filter("orientation = 1")
        return top_k(forward, keys, scan_order(), MAX_BUDGET, F.lit(limit)).select(*keys, "rank", *values)

    whole = first_rows(anchored_edges(corpus, scans, keys))
    split = first_rows(
        anchored_edges(parts, scans, [*keys, "pack_id"], shard=["pack_id"], resolve=resolve_in_partition(tables))
    )
    none = F.lit(None)
    relations = compare_ranked(scans, whole, split, keys, values).select(
        F.lit("relations").alias("kind"), *keys, none.cast("string").alias("item"), "divergent", "first_difference"
    )

    def sense_rows(source: Corpus, shard: list[str]) -> DataFrame:
        found = (
            sampled.join(
                source.terms.select("term_id", F.col("normalized_term").alias("word"), "language", *shard),
                ["word", "language", *shard],
            )
            .join(source.entries.select("entry_id", "term_id", "part_of_speech", *shard), ["term_id", *shard])
            .join(source.senses.select("sense_id", "entry_id", "gloss", *shard), ["entry_id", *shard])
        )
        order = [F.col("gloss").isNull(), "sense_id"]
        return top_k(found, ["language", "word"], order, MAX_BUDGET, F.lit(limit))

    whole_senses, split_senses = sense_rows(corpus, []), sense_rows(parts, ["pack_id"])
    senses = compare_ranked(
        sampled, whole_senses, split_senses, ["language", "word"], ["sense_id", "part_of_speech", "gloss"]
    ).select(
        F.lit("senses").alias("kind"), "language", "word", none.cast("int").alias("relation_code"),
        none.cast("string").alias("item"), "divergent", "first_difference",
    )

    asked = split_senses.filter("rank <= 3").select("language", "word", "pack_id", "sense_id")
    order = ["position", "target_language", "target_normalized", "target_term"]

    def translated(links: DataFrame, names: DataFrame, shard: list[str]) -> DataFrame:
        named = asked.join(links.select("sense_id", "target_term_id", "position", *shard), ["sense_id", *shard]).join(
            names, ["target_term_id", *shard]
        )
        return top_k(named, ["language", "word", "sense_id"], order, MAX_BUDGET, F.lit(limit))

    def names_of(terms: DataFrame, shard: list[str]) -> DataFrame:
        return terms.select(
            F.col("term_id").alias("target_term_id"), F.col("term").alias("target_term"),
            F.col("normalized_term").alias("target_normalized"), F.col("language").alias("target_language"), *shard,
        )

    resolvable = names_of(tables["terms"], ["pack_id"]).unionByName(
        names_of(tables["target_catalogue"], ["pack_id"])
    )
    translations = compare_ranked(
        asked,
        translated(corpus.translations, names_of(corpus.terms, []), []),
        translated(tables["translations"], resolvable, ["pack_id"]),
        ["language", "word", "sense_id"],
        ["target_term", "target_normalized", "target_language", "position"],
    ).select(
        F.lit("translations").alias("kind"), "language", "word", none.cast("int").alias("relation_code"),
        F.col("sense_id").alias("item"), "divergent", "first_difference",
    )
    return relations.unionByName(senses).unionByName(translations)


def differential_summary(checks: DataFrame) -> DataFrame:
    """Questions compared and found different, per kind and language."""
    return checks.groupBy("kind", "language").agg(
        F.count(F.lit(1)).alias("checked"), F.sum(F.col("divergent").cast("bigint")).alias("divergent")
    )
