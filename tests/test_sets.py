"""Mergeable distinct counts, nested answers and vector partitions against small loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from glossweave.operators import sets, vectors
from glossweave.schemas import TABLES, Corpus
from glossweave.sources.common import intern

GROUPS = ["a", "b"]


def test_sets_merge_and_roll_up(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), rng.choice(["p", "q", None]), rng.choice([0, 1, 32767, 32768, 99999, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, n bigint")
    parts = [sets.set_table(df.filter(c), GROUPS, "n") for c in ("a = 'x'", "a <> 'x' AND n < 5", "a <> 'x' AND n >= 5", "a = 'z'")]
    got = {(r["level"], r["a"], r["b"]): r["size"] for r in sets.rollup_sizes(sets.merge_sets(parts, GROUPS), GROUPS, "size").collect()}
    expected: dict[tuple, set] = {}
    for a, b, n in rows:
        for key in ((2, a, b), (1, a, None), (0, None, None)):
            if n is not None:
                expected.setdefault(key, set()).add(n)
    assert got == {k: len(v) for k, v in expected.items()}
    # a coarser merge is the same as a merge followed by a count per coarser group
    coarse = sets.merge_sets(parts, ["a"]).groupBy("a").agg(F.sum(F.bitmap_count("members")).alias("n"))
    assert {r["a"]: r["n"] for r in coarse.collect()} == {k[1]: len(v) for k, v in expected.items() if k[0] == 1}


def test_sets_of_nothing(spark):
    none = sets.set_table(spark.createDataFrame([], "a string, b string, n bigint"), GROUPS, "n")
    assert sets.rollup_sizes(sets.merge_sets([none, none], GROUPS), GROUPS, "size").collect() == []


def _translations(spark, pairs):
    terms = intern(spark.createDataFrame([(f"l{k:03}", f"w{k}") for k in range(130)], "language string, term string")).cache()
    ids = {r["language"]: r["term_id"] for r in terms.collect()}
    rows = [(sense, ids[f"l{k:03}"]) for sense, k in pairs]
    return Corpus(terms=terms, translations=spark.createDataFrame(rows, "sense_id string, target_term_id bigint"))


def test_coverage_over_more_languages_than_a_word_of_bits(spark):
    pairs = [("all", k) for k in range(130)] + [("one", 63)] * 5 + [("edge", 64), ("edge", 127), ("edge", 128)]
    got = {r["sense_id"]: (r["language_count"], r["translation_count"]) for r in sets.coverage_by_bits(_translations(spark, pairs)).collect()}
    assert got == {"all": (130, 130), "one": (1, 5), "edge": (3, 3)}
    plan = sets.coverage_by_bits(_translations(spark, pairs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(sense_id") == 1


def test_coverage_without_terms(spark):
    empty = Corpus(terms=spark.createDataFrame([], TABLES["terms"]), translations=spark.createDataFrame([], TABLES["translations"]))
    assert sets.coverage_by_bits(empty).collect() == []


def test_vector_partition_numbers_and_files(spark, tmp_path):
    words = [("hot", f"w{k}") for k in range(60)] + [("cold", f"w{k}") for k in range(3)]
    terms = intern(spark.createDataFrame(words, "language string, term string")).cache()
    held = terms.filter("term <> 'w2'")  # a term without a vector takes no number
    rows = held.select(
        F.monotonically_increasing_id().alias("semantic_id"), F.col("term").alias("concept"), "term_id",
        F.array(F.lit(1.0).cast("float")).alias("embedding"),
    ).cache()
    parts = vectors.vector_partition(Corpus(terms=terms, vectors=rows))
    vectors.write_vector_partitions(parts, str(tmp_path / "v"), rows_per_file=20)
    read = spark.read.parquet(str(tmp_path / "v")).collect()
    for language in ("hot", "cold"):
        own = sorted((r["local_id"], r["term"]) for r in read if r["language"] == language)
        assert own == list(enumerate(sorted(t for l, t in words if l == language and t != "w2")))
    only = vectors.vector_partition(Corpus(terms=terms, vectors=rows), ["cold"])
    assert {(r["language"], r["local_id"]) for r in only.collect()} == {("cold", 0), ("cold", 1)}
