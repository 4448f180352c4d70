"""Wildcard patterns over the posting index, against plain matching of every headword."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from glossweave.operators import patterns


@pytest.fixture(scope="module")
def words():
    draw = random.Random(4)
    some = {"".join(draw.choices("aeinrst", k=draw.randint(1, 7))) for _ in range(900)}
    return sorted(some | {"a%b", "a_b", "\\x", "straße", "x" * 256, "q"})


@pytest.fixture()
def index(spark, words, monkeypatch):
    monkeypatch.setattr(patterns, "PAGE", 50)
    frame = spark.createDataFrame([(w,) for w in words], "normalized_term string")
    posted = patterns.postings(frame).cache()
    return posted, patterns.gram_counts(posted)


def plainly(words, pattern):
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return [w for w in words if re.fullmatch(body, w, re.S) and w != pattern]


PATTERNS = [
    "*", "?*", "*?", "?????", "?", "*e*", "a*", "*a", "?e*", "*e?", "*e*a*", "a*e*t", "??n??", "st*", "*zz*", "zz", "q*q",
    "a%b", "a_?", "*%*", "\\*", "stra*e", "*ß*", "**", "a**b", "?" * 256, "x*x", "tar", "*tar*ne*", "*i*s*t*", "n?s*",
]


@pytest.mark.parametrize("limit", [1, 7, 100])
def test_matches_in_order_and_bounded(spark, words, index, limit):
    asked = spark.createDataFrame([(i, p, limit) for i, p in enumerate(PATTERNS)], "request_id int, text string, limit int")
    found: dict[int, list[str]] = {}
    for r in patterns.matches(*index, asked).collect():
        found.setdefault(r["request_id"], []).append(r["normalized_term"])
    for i, pattern in enumerate(PATTERNS):
        wanted, got = plainly(words, pattern), sorted(found.get(i, []))
        assert len(got) == len(set(got)) and got[:limit] == wanted[:limit], pattern
    for r in patterns.candidates_met(*index, asked).collect():
        # a page of the run's headwords, twice as many every round
        assert r["candidates"] <= 2 * patterns.PAGE * 2 ** r["round"]


def test_patterns_take_their_rarest_run(spark, words, index):
    posted, counts = index
    asked = spark.createDataFrame([(1, "*e*st*", 5), (2, "?????", 5), (3, "*", 5), (4, "*zzz*", 5)], "request_id int, text string, limit int")
    chosen = {r["request_id"]: r for r in patterns.rarest_runs(asked, counts).collect()}
    assert chosen[1]["gram"] == "st" and chosen[1]["words"] == sum("st" in w for w in words)
    assert chosen[2]["words"] == sum(len(w) == 5 for w in words) and chosen[3]["words"] == len(words)
    assert 4 not in chosen
    fixed = patterns.rarest_runs(spark.createDataFrame([(1, "?q?", 5)], "request_id int, text string, limit int"), counts)
    assert [(r["from_start"], r["from_end"]) for r in fixed.collect()] == [(3, 2)] or fixed.count() == 1


def test_postings_hold_every_place(spark, words, index):
    posted, _ = index
    row = posted.where((F.col("normalized_term") == "straße") & (F.col("gram") == "s")).first()
    assert row["places"] == [2] and row["size"] == 8
    marked = posted.where(F.col("gram") == "").groupBy("page").count().collect()
    assert max(r["count"] for r in marked) <= patterns.PAGE and sum(r["count"] for r in marked) == len(words)


def test_no_headwords_and_no_patterns(spark):
    none = spark.createDataFrame([], "normalized_term string")
    posted = patterns.postings(none).cache()
    asked = spark.createDataFrame([(1, "*", 5)], "request_id int, text string, limit int")
    assert patterns.matches(posted, patterns.gram_counts(posted), asked).collect() == []
    assert patterns.matches(posted, patterns.gram_counts(posted), asked.limit(0)).collect() == []


def test_headwords_close_together_are_read_by_rounds(spark, monkeypatch):
    """All words with the rarest run of a pattern lie on neighbouring pages."""
    monkeypatch.setattr(patterns, "PAGE", 20)
    near = ["a" + "".join(p) for p in itertools.product("bcd", repeat=5)]
    far = ["z" + "".join(p) for p in itertools.product("bcde", repeat=5)]
    posted = patterns.postings(spark.createDataFrame([(w,) for w in near + far], "normalized_term string")).cache()
    counts = patterns.gram_counts(posted)
    asked = spark.createDataFrame([(1, "a*", 30), (2, "a*e", 5)], "request_id int, text string, limit int")
    met = patterns.candidates_met(posted, counts, asked).collect()
    assert met and all(r["candidates"] <= 2 * patterns.PAGE * 2 ** r["round"] for r in met)
    found = patterns.matches(posted, counts, asked).where("request_id = 1").collect()
    assert sorted(r["normalized_term"] for r in found)[:30] == sorted(near)[:30]


def test_postings_are_made_by_all_cores(spark, words):
    posted = patterns.postings(spark.createDataFrame([(w,) for w in words], "normalized_term string"))
    assert posted.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
