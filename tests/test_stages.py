"""Rows per provenance: children that tell their entry's provenance are counted where they lie."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.plans import driver_tables, quality
from glossweave.schemas import Corpus


def _rows(frame):
    return sorted(map(tuple, frame.select("metric", "provenance_id", "observed").collect()))


def test_children_that_tell_their_provenance_do_not_meet_their_parents(spark):
    words = [(f"e{k}", 5 + k % 2) for k in range(40)]
    entries = spark.createDataFrame(words, "entry_id string, provenance_id int")
    # e0 has no sense; a sense or an example without an id belongs nowhere
    senses = entries.filter("entry_id <> 'e0'").select(
        F.concat("entry_id", F.lit("/a")).alias("sense_id"), "entry_id", F.col("provenance_id").alias("owner_provenance")
    )
    senses = senses.unionByName(senses.limit(1).withColumn("entry_id", F.lit(None).cast("string")))
    examples = senses.filter("entry_id is not null").select("sense_id", "owner_provenance", F.explode(F.sequence(F.lit(1), F.lit(3))))
    examples = examples.unionByName(examples.limit(1).withColumn("sense_id", F.lit(None).cast("string")))
    tables = {"senses": senses, "examples": examples, "pronunciations": entries.withColumnRenamed("provenance_id", "owner_provenance")}
    told = quality.stage_counts(Corpus(entries=entries, **tables))
    plain = quality.stage_counts(Corpus(entries=entries, **{n: t.drop("owner_provenance") for n, t in tables.items()}))
    assert _rows(told) == _rows(plain)
    assert ("examples", 5, 57) in _rows(told) and ("examples", 6, 60) in _rows(told)
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_tables_read_once_count_as_the_stored_ones(spark):
    folder = "/root/testdata/sf0.001"
    stored = quality.stage_counts(driver_tables.word_corpus(spark, folder))
    made = quality.stage_counts(driver_tables.word_corpus(spark, folder, read_once=True))
    assert _rows(made) == _rows(stored)
