"""Partitions by language: rows that tell their language, and files written in one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.plans import layout, quality
from glossweave.schemas import OWNER_LANGUAGE, TABLES, Corpus
from glossweave.sources.common import intern

PLAN = [("en", "p1"), ("fr", "p2"), ("de", "p2")]


def corpus_of(spark):
    words = [(lang, f"w{k}") for lang, n in (("en", 40), ("fr", 30), ("de", 20)) for k in range(n)]
    terms = intern(spark.createDataFrame(words, "language string, term string")).cache()
    entries = terms.select(
        F.concat_ws(":", "language", "term").alias("entry_id"), "term_id", F.lit("noun").alias("part_of_speech"),
        F.lit(None).cast("string").alias("etymology"), F.lit(1).alias("provenance_id"),
    )
    senses = entries.select(F.concat("entry_id", F.lit("/a")).alias("sense_id"), "entry_id", F.lit("g").alias("gloss"))
    other = terms.select(F.col("term_id").alias("target_term_id"), "term", F.col("language").alias("own"))
    links = terms.join(other, "term").filter("language <> own").select(
        F.concat("language", F.lit(":"), "term", F.lit("/a")).alias("sense_id"), "target_term_id",
        F.lit(None).cast("string").alias("part_of_speech"), F.lit(1).alias("provenance_id"),
        F.lit(0).cast("bigint").alias("position"), F.col("language").alias(OWNER_LANGUAGE),
    )
    none = {n: spark.createDataFrame([], TABLES[n]) for n in ("relations",)}
    counts = terms.select("term_id", F.lit(1).alias("entry_count"), F.lit(1).alias("sense_count"))
    return Corpus(terms=terms, entries=entries, senses=senses, translations=links, term_counts=counts, **none)


def test_rows_that_tell_their_language_do_not_meet_their_senses(spark):
    corpus = corpus_of(spark)
    plan = spark.createDataFrame(PLAN, "language string, pack_id string")
    # a row without a sense belongs nowhere
    told = corpus.translations.unionByName(corpus.translations.limit(1).withColumn("sense_id", F.lit(None).cast("string")))
    plain = corpus.extended(translations=corpus.translations.drop(OWNER_LANGUAGE))
    got = layout.repartition_by_language(corpus.extended(translations=told), plan)
    wanted = layout.repartition_by_language(plain, plan)
    for name in ("translations", "target_catalogue"):
        columns = wanted[name].columns
        assert sorted(got[name].columns) == sorted(columns)
        assert sorted(map(str, got[name].select(*columns).collect())) == sorted(map(str, wanted[name].collect()))
    assert got["target_catalogue"].count() == 80
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        text = got["target_catalogue"]._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(sense_id" not in text
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_a_table_is_made_once_when_it_is_written_by_partition(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).withColumn("pack_id", F.when(F.col("id") < 900, "big").otherwise(F.concat(F.lit("p"), F.col("id") % 7)))
    layout.write_partitions({"t": rows.mapInArrow(seen, rows.schema)}, str(tmp_path), rows_per_file=200)
    assert made.value == 1000
    assert len(list((tmp_path / "t" / "pack_id=big").glob("*.parquet"))) >= 5
    again = spark.read.schema(rows.schema).parquet(str(tmp_path / "t"))
    assert sorted(map(tuple, again.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_differential_tables_are_cut_to_the_sample(spark):
    corpus = corpus_of(spark)
    plan = spark.createDataFrame(PLAN, "language string, pack_id string")
    tables = layout.repartition_by_language(corpus, plan)
    sampled = spark.createDataFrame([("en", "w3", "p1"), ("fr", "w25", "p2")], "language string, word string, pack_id string")
    near, parts = quality._around(corpus, tables, sampled)
    # w3 in three languages; w25 in French and, as its translation, in English
    wanted = {("en", "w3"), ("fr", "w3"), ("de", "w3"), ("fr", "w25"), ("en", "w25")}
    for terms in (near.terms, parts["terms"]):
        assert {(r["language"], r["term"]) for r in terms.collect()} == wanted
    assert near.entries.count() == near.senses.count() == parts["senses"].count() == 5
    assert near.translations.count() == parts["translations"].count() == 3


def test_closure_reads_what_edges_point_at_once(spark):
    corpus = corpus_of(spark)
    plan = spark.createDataFrame(PLAN, "language string, pack_id string")
    # every link stands as a synonym too, so that those to the other partition are foreign, each row of them
    twice = corpus.translations.unionByName(corpus.translations)
    seen = []

    def shared(referenced):
        seen.append(referenced.cache())
        return seen[0]

    parts = layout.repartition_by_language(corpus.extended(synonyms=twice), plan, shared=shared)
    report = layout.closure_report(parts, seen[0])
    rows = sorted(map(tuple, report.collect()))
    assert rows == sorted(map(tuple, layout.closure_report(parts).collect()))
    # p1: 30 French and 20 German targets; p2: 30 and 20 English ones, each from rows that stand twice
    assert rows == [("p1", 0, 100, 0, False), ("p2", 0, 100, 0, False)]
    broken = {**parts, "target_catalogue": parts["target_catalogue"].filter("term <> 'w3'")}
    assert {r["pack_id"]: r["dangling"] for r in layout.closure_report(broken, seen[0]).collect()} == {"p1": 2, "p2": 1}
    counted = {**parts, "synonyms": layout.pointed(parts["synonyms"])}
    assert sorted(map(tuple, layout.closure_report(counted, seen[0]).collect())) == rows
