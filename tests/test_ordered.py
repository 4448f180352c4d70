"""Order-sensitive digests against a chained pass."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from glossweave.sources.ordered import BASES, PRIMES, changed_sources, ordered_digest
from glossweave.sources.text import read_lines


def chained(texts):
    lanes = [0] * len(PRIMES)
    for text in texts:
        digest = hashlib.sha256(("-" if text is None else "+" + text).encode()).hexdigest()
        for k, p in enumerate(PRIMES):
            lanes[k] = (lanes[k] * BASES[k] + int(digest[15 * k : 15 * k + 15], 16)) % p
    return len(texts), "-".join(map(str, lanes))


def told(df):
    return {r["source"]: (r["rows"], r["digest"]) for r in df.collect()}


def test_primes_and_bases():
    assert len(set(PRIMES)) == len(set(BASES)) == 4
    assert all(all(p % d for d in range(2, 47_000)) for p in PRIMES)


def test_equals_a_chained_pass_whatever_the_partitioning(spark):
    draw = random.Random(2)
    rows = [(f"f{draw.randrange(4)}", draw.randrange(3), k, draw.choice([None, "", "a", f"row {k}"]), draw.choice("xy")) for k in range(700)]
    wanted = {
        s: chained([r[3] for r in sorted(rows, key=lambda r: r[:3]) if r[4] == s]) for s in "xy"
    }
    frame = spark.createDataFrame(rows, "file string, block long, at long, text string, src string")
    for parts in (1, 3, 11):
        assert told(ordered_digest(frame.repartition(parts), F.col("text"), F.col("src"))) == wanted
    assert ordered_digest(frame.limit(0), F.col("text")).collect() == []
    # one row after the other: no row of the same text can hide a swap
    swapped = frame.withColumn("at", F.when(F.col("at") == 3, 1000).otherwise(F.col("at")))
    changed = changed_sources(ordered_digest(frame, F.col("text"), F.col("src")), ordered_digest(swapped, F.col("text"), F.col("src")))
    assert [r["source"] for r in changed.collect()] == [rows[3][4]]


@pytest.mark.parametrize("files", [1, 2, 5])
def test_files_and_tasks_leave_no_trace(spark, tmp_path, files):
    """The same lines in other files have the same digest, sorted or as they are read."""
    lines = [f"line {k % 90}" for k in range(400)]
    step = -(-len(lines) // files)
    for k in range(files):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(lines[k * step : (k + 1) * step]) + "\n")
    read = read_lines(spark, str(tmp_path))
    wanted = {"": chained(lines)}
    assert told(ordered_digest(read, F.col("line"), in_order=True)) == wanted
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        cut = read_lines(spark, str(tmp_path))
        assert cut.rdd.getNumPartitions() > files
        assert told(ordered_digest(cut, F.col("line"), in_order=True)) == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
