"""Lookups over bucketed tables: the same rows, and the dictionary is not shuffled."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from glossweave.operators import lookup
from glossweave.plans.bucketed import bucketed_corpus
from glossweave.schemas import TABLES, Corpus
from glossweave.sources.common import intern


def corpus_of(spark):
    words = [("en", f"W{k % 90}") for k in range(120)] + [("fr", f"w{k}") for k in range(40)]
    terms = intern(spark.createDataFrame(words, "language string, term string")).cache()
    entries = terms.select(
        F.concat_ws(":", "language", "term").alias("entry_id"), "term_id", F.lit("noun").alias("part_of_speech"),
        F.lit(None).cast("string").alias("etymology"), F.lit(1).alias("provenance_id"),
    )
    senses = entries.select(
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("k"), "entry_id"
    ).select(F.concat_ws("/", "entry_id", "k").alias("sense_id"), "entry_id", F.when(F.col("k") == "a", "gloss").alias("gloss"))
    none = {n: spark.createDataFrame([], TABLES[n]) for n in ("translations", "examples", "pronunciations")}
    return Corpus(terms=terms, entries=entries, senses=senses, **none)


def above(plan: str, table: str) -> list[str]:
    """Operators between the scan of a table and the first join over it."""
    lines = plan.splitlines()
    place = next(k for k, line in enumerate(lines) if re.search(rf"\.{table}_[0-9a-f]{{32}}", line))
    depth, found = len(re.match(r"[ :+-]*", lines[place]).group()), []
    for line in reversed(lines[:place]):
        own = len(re.match(r"[ :+-]*", line).group())
        if own < depth:
            depth = own
            found.append(line.strip(" :+-"))
            if "Join" in line:
                break
    return found


def test_bucketed_lookup(spark):
    corpus = corpus_of(spark)
    laid = bucketed_corpus(corpus, 3)
    asked = spark.createDataFrame(
        [(k, f"w{k}", "en" if k % 3 else "fr", None, None) for k in range(60)],
        "request_id int, word string, language string, part_of_speech string, sense_id string",
    )
    rows = lambda c: sorted(map(str, lookup.lookup(c, asked.drop("sense_id", "part_of_speech")).collect()))
    assert rows(laid) == rows(corpus) and len(rows(laid)) > 60
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = lookup.sense_candidates(laid, asked, F.lit(5))
        plan = found._jdf.queryExecution().executedPlan().toString()
        for table in ("terms", "entries", "senses"):
            path = above(plan, table)
            assert "SortMergeJoin" in path[-1] and not any("Exchange" in p for p in path), path
        assert plan.count("Exchange hashpartitioning(word") == 1  # the requests
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def told_corpus(spark):
    """Senses that tell their provenance, translations that tell their target's language."""
    corpus = corpus_of(spark)
    targets = corpus.terms.select(F.col("term_id").alias("target_term_id"), F.col("language").alias("told_language"), "term")
    pairs = corpus.terms.select(F.concat("language", F.lit(":"), "term", F.lit("/b")).alias("sense_id"), "term_id").crossJoin(
        targets.filter("term in ('W3', 'W4', 'w5')")
    ).filter("term_id <> target_term_id and pmod(term_id + target_term_id, 3) <> 0")
    translations = pairs.select(
        "sense_id", "target_term_id", F.lit(None).cast("string").alias("part_of_speech"), F.lit(1).alias("provenance_id"),
        F.lit(0).cast("bigint").alias("position"), "told_language",
    )
    return corpus.extended(translations=translations, senses=corpus.senses.withColumn("owner_provenance", F.lit(1)))


def test_translations_that_tell_their_language_do_not_meet_their_targets(spark):
    told = told_corpus(spark)
    plain = told.extended(translations=told.translations.drop("told_language"))
    got, wanted = (lookup.translation_coverage(c) for c in (told, plain))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert {r["language_count"] for r in got.collect()} == {1, 2}
    joins = [f._jdf.queryExecution().optimizedPlan().toString().count("Join ") for f in (got, wanted)]
    assert joins[0] == joins[1] - 1, joins


def test_lookup_of_all_words_finds_them_once(spark):
    laid = bucketed_corpus(told_corpus(spark), 3)
    assert laid.senses.columns == TABLES["senses"].fieldNames()
    asked = laid.terms.select(F.col("normalized_term").alias("word"), "language").distinct().withColumn(
        "request_id", F.concat_ws(":", "language", "word")
    ).withColumn("limit", F.lit(1))
    some, every = (lookup.lookup(laid, asked, True, all_words=flag) for flag in (False, True))
    assert sorted(map(str, every.collect())) == sorted(map(str, some.collect()))
    # the reserved place goes to a translated sense
    assert every.count() == asked.count()
    scans = [len(re.findall(r"Relation spark_catalog\.default\.senses_", f._jdf.queryExecution().optimizedPlan().toString())) for f in (some, every)]
    assert scans == [2, 1], scans
