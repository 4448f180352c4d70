"""Comparison of tables by digests against plain counting of rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossweave.plans.drilldown import STEP, compare_tables


def plainly(left, right):
    one, two = Counter(left), Counter(right)
    keys = [Counter(r[0] for r in rows) for rows in (left, right)]
    found = Counter()
    for row in one.keys() | two.keys():
        if one[row] != two[row]:
            state = "added" if not keys[0][row[0]] else "removed" if not keys[1][row[0]] else "changed"
            found[row[0], state, one[row], two[row]] += 1
    return found


@pytest.mark.parametrize("changes", [0, 1, 60, 3000])
def test_differences(spark, changes):
    draw = random.Random(changes)
    left = [(k if k % 50 else None, f"v{k % 7}" if k % 11 else None, float(k % 3)) for k in range(3000)] + [(5, "same", 1.0)] * 4
    right = list(left)
    for _ in range(changes):
        k = draw.randrange(len(right))
        right[k] = draw.choice([(right[k][0], "other", 2.0), (9000 + k, "new", 0.0), right[k - 1]])
    right = right[: len(right) - (changes > 0)]
    frames = [spark.createDataFrame(rows, "id long, v string, x double") for rows in (left, right)]
    found = compare_tables(frames[0], frames[1].repartition(3).select("x", "id", "v"), ["id"], rows_enough=50)
    assert Counter(map(tuple, found.differences.collect())) == plainly(left, right)
    if not changes:
        # one level of digests and nothing else
        assert found.levels == [(2**STEP, 0)]
    if changes == 1:
        assert len(found.levels) > 1 and all(differ <= 3 for _, differ in found.levels)


def test_empty_tables_and_other_columns(spark):
    frame = spark.createDataFrame([(1, "a")], "id long, v string")
    none = frame.limit(0)
    assert compare_tables(none, none, ["id"]).differences.collect() == []
    assert [tuple(r) for r in compare_tables(none, frame, ["id"]).differences.collect()] == [(1, "added", 0, 1)]
    with pytest.raises(ValueError):
        compare_tables(frame, frame.withColumn("w", F.lit(1)), ["id"])
