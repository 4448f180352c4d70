"""The trained vector index against exact search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossweave.operators import vector_index as vi, vectors
from glossweave.schemas import Corpus


def corpus_of(spark, rows):
    frame = spark.createDataFrame(rows, "semantic_id long, term string, language string, embedding array<float>")
    frame = frame.withColumn("term_id", F.col("semantic_id")).withColumn("normalized_term", F.lower("term")).cache()
    return Corpus(
        terms=frame.select("term_id", "term", "normalized_term", "language"),
        vectors=frame.select("semantic_id", F.col("term").alias("concept"), "term_id", "embedding"),
    )


@pytest.fixture(scope="module")
def corpus(spark):
    """Clustered vectors, one cell with a third of them, terms with several vectors, equal vectors, a zero vector."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 10))
    own = np.where(rng.random(1500) < 0.34, 0, rng.integers(0, 40, 1500))
    points = centres[own] + 0.4 * rng.normal(size=(1500, 10))
    points[700:720] = points[700]
    points[3] = 0
    rows = [(k, f"W{k // 2 if k < 300 else k}", ("en", "fr", "de")[k % 3], [float(x) for x in p]) for k, p in enumerate(points)]
    return corpus_of(spark, rows)


@pytest.fixture(scope="module")
def requests(spark, corpus):
    words = corpus.terms.where("term_id % 9 = 0").select("normalized_term", "language").distinct().collect()
    rows = [
        (f"{n}/{t}", r["normalized_term"], r["language"], target, 7 if n % 2 else 3, 0.2 if n % 3 else None)
        for n, r in enumerate(words) for t, target in enumerate([None, "fr", r["language"]])
    ]
    rows.append(("none", "no such word", "en", None, 5, None))
    return spark.createDataFrame(
        rows, "request_id string, word string, source_language string, target_language string, limit int, min_similarity double"
    )


@pytest.fixture(scope="module")
def index(corpus):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vi, "BLOCK_ROWS", 60)
        patch.setattr(vi, "QUERY_ROWS", 50)
        yield vi.build_index(corpus)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("request_id", "rank", "semantic_id", "similarity").collect())


def test_bounded_search_is_exact_with_few_full_scores(corpus, requests, index):
    assert rows_of(vi.bounded_neighbours(index, requests, decimals=5)) == rows_of(vectors.neighbours(corpus, requests, decimals=5))
    asked = requests.where("target_language IS NULL AND limit = 3")
    counted = vi.scored_share(index, asked, None).agg(F.sum("scored"), F.sum("size")).first()
    assert counted[0] < 0.5 * counted[1]


def test_indexed_search_recalls_and_keeps_its_share(corpus, requests, index):
    wide = requests.where("request_id LIKE '%/0'").withColumn("limit", F.lit(10)).drop("min_similarity")
    truth = {(r[0], r[2]) for r in rows_of(vectors.neighbours(corpus, wide))}
    found = {(r[0], r[2]) for r in rows_of(vi.indexed_neighbours(index, wide))}
    assert len(truth & found) >= 0.9 * len(truth)
    share = vi.scored_share(index, wide, vi.RESCORED).agg(F.max(F.col("scored") / F.col("size"))).first()[0]
    assert share <= 0.31
    # fewer cells, fewer hits, and never a foreign language
    some = rows_of(vi.indexed_neighbours(index, wide, visited=0.05))
    assert 0 < len(truth & {(r[0], r[2]) for r in some}) < len(truth)
    strict = vi.indexed_neighbours(index, requests.where("target_language = 'fr'"))
    assert {r["language"] for r in strict.collect()} == {"fr"}


def test_blocks_are_bounded_and_hold_every_vector_once(corpus, index):
    blocks = index.blocks.collect()
    assert sum(r["rows"] for r in blocks) == 1499 and max(r["rows"] for r in blocks) <= 150
    ids = sorted(i for r in blocks for i in np.frombuffer(r["ids"], "<i8").tolist())
    assert ids == [k for k in range(1500) if k != 3]
    assert {r["scope"]: r["size"] for r in index.sizes.collect()}["*"] == 1499


def test_training_does_not_depend_on_order_and_index_can_be_opened(spark, corpus, requests, index, tmp_path, monkeypatch):
    shuffled = Corpus(terms=corpus.terms, vectors=corpus.vectors.repartition(7, "embedding"))
    monkeypatch.setattr(vi, "BLOCK_ROWS", 60)
    again = vi.build_index(shuffled, str(tmp_path / "index"))
    assert np.array_equal(again.model.centres, index.model.centres) and np.array_equal(again.model.books, index.model.books)
    opened = vi.open_index(spark, str(tmp_path / "index"))
    assert np.array_equal(opened.model.books, index.model.books)
    wanted = rows_of(vi.indexed_neighbours(index, requests))
    assert rows_of(vi.indexed_neighbours(opened, requests)) == wanted


def test_k_means_equals_plain_rounds(spark, corpus):
    found = vectors.named_vectors(corpus)
    model = vi.train(found, rows=200, rounds=2, cells=5)
    rows = found.select("semantic_id", "embedding").orderBy(vi.hash60(F.lit(17), F.col("semantic_id")), "semantic_id").limit(200).collect()
    points = np.array([r["embedding"] for r in rows])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centres = points[:5].copy()
    for _ in range(2):
        own = np.argmin(((points[:, None] - centres[None]) ** 2).sum(axis=2), axis=1)
        for k in range(5):
            if (own == k).any():
                centres[k] = points[own == k].mean(axis=0)
    assert np.allclose(model.centres, centres, atol=1e-6)


def test_report(corpus, index):
    rows = {r["index_scope"]: r for r in vi.index_report(corpus, index, 5, 5).collect()}
    assert set(rows) == {"global", "language"}
    for r in rows.values():
        assert r["seeds"] == 15 and r["passed"] and r["deterministic"] and r["strict_language_filtering"]
        assert 0 < r["scored_share"] <= 0.31


def test_empty_corpus(spark, requests):
    empty = vi.build_index(corpus_of(spark, []))
    assert vi.indexed_neighbours(empty, requests).collect() == []
    assert vi.bounded_neighbours(empty, requests).collect() == []


def test_rows_scored_in_full_are_not_all_put_in_order(monkeypatch):
    """Most rows that a share of a block scores cannot be among the best: they are left out before sorting."""
    draw = np.random.default_rng(3)
    given = draw.normal(size=(2000, 8)).astype("f4")
    unit = given / np.linalg.norm(given.astype(float), axis=1, keepdims=True)
    model = vi.Model(unit[:4].copy(), np.stack(np.split(unit[:64] * 0.5, 2, axis=1)))
    cells, ids = model.cells(unit).astype("i4"), np.arange(2000).astype("i8")
    scales = np.abs(unit).max(axis=1) / 127
    values = {
        "ids": ids, "identities": ids, "cells": cells, "codes": model.codes(unit - model.centres[cells]).astype("u1"),
        "bytes": np.rint(unit / scales[:, None]).astype("i1"), "scales": scales, "slack": np.zeros(2000), "full": given,
    }
    block = pa.table({n: pa.array([v.tobytes()], pa.binary()) for n, v in values.items()})
    asked = pa.table({
        "question": [str(i) for i in range(50)], "identity": ids[:50], "embedding": pa.array(list(given[:50]), pa.list_(pa.float32())),
        "keep": np.full(50, 5), "size": np.full(50, 2000),
    })
    sorted_rows, plain = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or plain(keys))
    found = vi._searched(model, 1.0, 0.3)(block, asked).to_pylist()
    assert max(sorted_rows) <= 2 * 5 * 50
    scores = unit[:50] @ unit.T
    for r in found:
        assert abs(r["similarity"] - scores[int(r["question"]), r["semantic_id"]]) < 1e-6 and r["scored"] >= 600


def test_blocks_are_shipped_to_few_slices(spark, corpus, requests, index, monkeypatch):
    monkeypatch.setattr(vi, "QUERY_ROWS", 2_048)
    counts = spark.createDataFrame([(n,) for n in (0, 1, 2_048, 10_256, 51_282, 615_384)], "n long")
    assert [r[0] for r in counts.select(vi._slices(F.col("n"))).collect()] == [0, 1, 1, 6, 8, 38]
    wanted = rows_of(vectors.neighbours(corpus, requests, decimals=4))
    monkeypatch.setattr(vi, "QUERY_ROWS", 5)
    monkeypatch.setattr(vi, "MOST_QUERY_ROWS", 60)
    monkeypatch.setattr(vi, "FEW_SLICES", 2)
    found = vi.bounded_neighbours(index, requests, decimals=4)
    assert rows_of(found) == wanted
    # hits are dealt by their question alone
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "identity#" in line]
    assert not dealt, dealt


def test_memory_of_cells_does_not_grow_with_the_rows_at_once():
    import tracemalloc

    rng = np.random.default_rng(3)
    points, centres = rng.normal(size=(10_000, 8)), rng.normal(size=(1_000, 8))
    tracemalloc.start()
    got = vi._nearest(points, centres)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40_000_000, most  # 10,000 x 1,000 scores are 80 MB
    assert np.array_equal(got[::97], [np.argmin(((centres - p) ** 2).sum(axis=1)) for p in points[::97]])
    assert len(vi._nearest(points[:0], centres)) == 0


@pytest.mark.parametrize("rescored,visited,good", [(0.3, 1.0, True), (0.05, 1.0, False), (0.3, 0.4, False), (None, 1.0, True)])
def test_blocks_of_a_cell_give_what_each_gives_alone(rescored, visited, good):
    """Best of several blocks, small ones and repeated identities among them, by good codes and by poor ones, against plain scoring."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(10, 8))
    model = vi.Model(centres / np.linalg.norm(centres, axis=1, keepdims=True), 0.5 * draw.normal(size=(2, 64, 4)))
    sizes, packed, plain, start = [900, 5, 1200, 300], [], [], 0
    for n in sizes:
        given = draw.normal(size=(n, 8)).astype("f4")
        unit = given / np.linalg.norm(given.astype(float), axis=1, keepdims=True)
        cells, ids = model.cells(unit).astype("i4"), np.arange(start, start + n).astype("i8")
        codes = (model.codes(unit - model.centres[cells]) if good else draw.integers(0, 64, (n, 2))).astype("u1")
        scales = np.abs(unit).max(axis=1) / 127
        small = np.rint(unit / scales[:, None])
        values = {
            "ids": ids, "identities": ids // 2, "cells": cells, "codes": codes, "bytes": small.astype("i1"), "scales": scales,
            "slack": np.linalg.norm(unit - small * scales[:, None], axis=1), "full": given,
        }
        packed.append({k: v.tobytes() for k, v in values.items()})
        plain.append((ids, cells, unit, model.decoded(cells, codes).astype(np.float32)))
        start += n
    asked = draw.normal(size=(90, 8)).astype("f4")
    query = asked / np.linalg.norm(asked.astype(float), axis=1, keepdims=True)
    keep = draw.integers(1, 12, 90)
    table = pa.table({
        "question": [str(i) for i in range(90)], "identity": np.arange(90) * 7, "embedding": pa.array(list(asked), pa.list_(pa.float32())),
        "keep": keep, "size": np.full(90, start),
    })
    found = vi._searched(model, visited, rescored, False)(pa.Table.from_pylist(packed), table).to_pylist()
    assert len(found) == keep.sum()
    for q in range(90):
        best = {}
        near = query[q] @ model.centres.T
        seen = np.argsort(-near)[: max(1, int(np.ceil(visited * 10)))]
        for ids, cells, unit, coded in plain:
            scores, exact = query[q].astype(np.float32) @ coded.T, query[q] @ unit.T
            barred = (ids // 2 == 7 * q) | ~np.isin(cells, seen)
            scores[barred] = -np.inf
            if rescored is not None:
                count = max(int(rescored * len(ids)), int(np.ceil(2 * keep[q] * len(ids) / start)), 1)
                barred |= scores < np.sort(scores)[-min(count, len(ids))]
            for at in np.flatnonzero(~barred):
                best[ids[at] // 2] = min(best.get(ids[at] // 2, (9.0, 0)), (-exact[at], ids[at]))
        wanted = [int(i) for _, i in sorted(best.values())[: keep[q]]]
        got = [r for r in found if r["question"] == str(q)]
        assert [r["semantic_id"] for r in got] == wanted


def test_a_question_has_hits_once_per_cell(corpus, requests, index, monkeypatch):
    asked = vi.with_defaults(requests, vi.NEIGHBOUR_DEFAULTS)
    rows, hits = [], []
    for cells_per_task in (1_000_000, 0.000001):
        monkeypatch.setattr(vi, "_CELLS_PER_TASK", cells_per_task)
        rows.append(rows_of(vi.indexed_neighbours(index, requests)) + rows_of(vi.bounded_neighbours(index, requests)))
        hits.append(vi._hits(index, asked, 1.0, vi.RESCORED)[0].count())
    assert rows[0] == rows[1] and hits[1] < hits[0] / 3
