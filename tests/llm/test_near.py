from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from glossweave.llm import near


def brute(rows, threshold=near.THRESHOLD, words=near.WORDS):
    """doc_id -> (class id, links) by comparing all pairs that share an n-gram."""
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for i, s in sets.items():
        shared = Counter(j for g in s for j in by[g] if j > i)
        for j, n in shared.items():
            if n >= threshold * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (root(i), links[i]) for i in sets}


def near_copies(seed, groups=12, size=9, length=120):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(groups):
        base = draw.choices(vocabulary, k=length)
        for _ in range(size):
            own = list(base)
            for _ in range(draw.randrange(0, 5)):
                own[draw.randrange(length)] = draw.choice(vocabulary)
            rows.append(" ".join(own))
    passage = draw.choices(vocabulary, k=60)
    rows += [" ".join(passage + draw.choices(vocabulary, k=90)) for _ in range(40)]
    draw.shuffle(rows)
    return list(enumerate(rows))


def result(spark, rows, extra="", **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return near.near_classes(near.near_join(docs, **settings)).collect()


def test_bands_reach_recall():
    bands, rows = near.choose_bands(0.8, 0.999, 160)
    assert bands * rows <= 160 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_against_all_pairs(spark, monkeypatch):
    rows = near_copies(1) + [(9000, None), (9001, ""), (9002, "a b"), (9003, "A  b"), (9004, "a b c")]
    expected = brute(rows)
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in result(spark, rows)}
    assert found == expected


def test_blocks_and_salts_change_nothing(spark, monkeypatch):
    rows = near_copies(2, groups=2, size=60)
    expected = brute(rows)
    monkeypatch.setattr(near, "BUCKET", 7)
    monkeypatch.setattr(near, "BLOCK_MEMBERS", 16)
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in result(spark, rows)}
    assert found == expected


def test_copies_and_missing_ids(spark):
    text = " ".join(f"x{k}" for k in range(50))
    rows = [(3, text), (1, text), (1, text), (None, text + " "), (7, "alone here with some more words")]
    got = result(spark, rows)
    assert [r["n_links"] for r in got if r["doc_id"] == 7] == [0]
    assert {(r["class_id"], r["n_links"]) for r in got if r["doc_id"] != 7} == {(1, 3)}
    assert sum(r["kept"] for r in got) == 2


def test_dropping_keeps_columns_and_one_row_of_each_class(spark):
    text = " ".join(f"x{k}" for k in range(80))
    rows = [(1, text, 5), (2, text + " more", 6), (3, "quite another text of its own", 7), (3, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `key` int")
    kept = near.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["key"] for r in kept.collect()) == [5, 7, 8]


def test_empty_table(spark):
    assert result(spark, []) == []


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (105, 101), (7, 7)]
    found = {r["node"]: r["root"] for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(41)) and found[105] == 100


@pytest.mark.parametrize("split", [None, 3])
def test_block_counts(split):
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 40, 30).astype(np.uint64)) for _ in range(8)]
    left, right = (sets, None) if split is None else (sets[:split], sets[split:])
    found = near.block_similar(left, right, 0.5)
    for i, a in enumerate(left):
        for j, b in enumerate(right or left):
            shared = len(set(a.tolist()) & set(b.tolist()))
            assert found[i, j] == (shared >= 0.5 * (len(a) + len(b) - shared))
