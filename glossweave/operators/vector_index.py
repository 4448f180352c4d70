"""A trained index over word vectors: cells, product codes and whole-byte codes in stored blocks.

Training is k-means in Spark jobs over a bounded sample: every round adds up, per partition
and in whole numbers, the vectors nearest to each centre, so that neither the order nor the
partitioning of the rows can change a centre. Cells are the centres of the vectors; what a
vector differs from its centre by is coded by one byte per group of components, from code
books trained in the same way. A second code holds one byte per component and a proven bound
of its error.

Every vector is then filed in a block of its language and of neighbouring cells. A search
meets blocks of queries with blocks of vectors, reads the codes of a block first, and scores
in full only what the codes leave open.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.ids import hash60
from ..schemas import MAX_BUDGET, Corpus
from ..session import shared_folder, written
from .ranking import first_per, top_k
from .requests import answer_shared, with_defaults
from .vectors import NEIGHBOUR_DEFAULTS, RECALL_BAR, Q, named_vectors, neighbours, recall_seeds

#: Most vectors that centres and code books are trained on, in the order of a hash of their id.
TRAIN_ROWS = 65_536
#: Most cells; below it there are as many as the square root of the number of vectors.
MAX_CELLS = 4_096
ROUNDS = 6
#: Components per byte of the product code.
GROUP = 4
CODES = 256
BLOCK_ROWS = 16_384
#: Queries of a slice: the fewer while there are few slices, so that all tasks have work; the more
#: then, since every block is shipped to every slice.
QUERY_ROWS = 2_048
MOST_QUERY_ROWS = 16_384
FEW_SLICES = 8
#: Most blocks of a cell, which meet its queries one after another: a query has hits once per cell,
#: and what it has found in one block bounds what the next must score. Fewer while cells are few.
MOST_BLOCKS = 8
_CELLS_PER_TASK = 4
#: Share of a block that is scored in full in an approximate search, at most.
RESCORED = 0.3
_FIXED = float(1 << 24)
# single precision of a dot product of unit vectors of up to some thousand components
_ROUNDING = 1e-4
#: Rows whose scores are held at once: queries by a block, and vectors by all centres.
_TILE = 64
_POINTS = 1_024
#: Share of a tile's scores above which all are taken by one product.
_MANY = 0.02


@dataclass
class Model:
    """Centres (cells × components) and code books (groups × codes × components of a group)."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return _nearest(unit, self.centres)

    def codes(self, rest: np.ndarray) -> np.ndarray:
        return np.column_stack([_nearest(part, book) for part, book in zip(_grouped(rest, self), self.books, strict=True)])

    def decoded(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Vectors as cell and codes tell them, looked up in the tables."""
        parts = [book[codes[:, k]] for k, book in enumerate(self.books)]
        return self.centres[cells] + np.concatenate(parts, axis=1)[:, : self.centres.shape[1]]


def _grouped(vectors: np.ndarray, model: Model) -> list[np.ndarray]:
    padded = np.pad(vectors, ((0, 0), (0, model.width - vectors.shape[1])))
    return np.split(padded, model.books.shape[0], axis=1)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(axis=1)
    lows = range(0, max(len(points), 1), _POINTS)
    return np.concatenate([np.argmax(points[low : low + _POINTS] @ centres.T - half, axis=1) for low in lows])


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(column: pa.Array) -> np.ndarray:
    vectors = _rows(column)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


# --------------------------------------------------------------------- training
def _improved(sample: DataFrame, groups: list[np.ndarray], model: Model | None) -> list[np.ndarray]:
    """One round of k-means, the groups of components each on their own.

    Sums are whole numbers, added up per partition and then per centre; what reaches the
    driver is as large as the centres. A centre that nothing is nearest to stays.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(c.shape, np.int64) for c in groups]
        counts = [np.zeros(len(c), np.int64) for c in groups]
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _units(batch.column(0))
            parts = [points]
            if model is not None:
                parts = _grouped(points - model.centres[model.cells(points)], model)
            for part, centres, total, count in zip(parts, groups, sums, counts, strict=True):
                own = _nearest(part, centres)
                np.add.at(total, own, np.rint(part * _FIXED).astype(np.int64))
                count += np.bincount(own, minlength=len(centres))
        for k, (total, count) in enumerate(zip(sums, counts, strict=True)):
            held = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(held), k)), pa.array(held), pa.array(count[held]),
                    pa.array(list(total[held]), pa.list_(pa.int64())),
                ],
                names=["part", "centre", "n", "sums"],
            )

    width = groups[0].shape[1]
    told = sample.select("embedding").mapInArrow(add, "part long, centre long, n long, sums array<long>")
    added = told.groupBy("part", "centre").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")
    )
    new = [c.copy() for c in groups]
    for r in added.collect():
        new[r["part"]][r["centre"]] = np.array(r["sums"], np.float64) / _FIXED / r["n"]
    return new


def train(vectors: DataFrame, seed: int = 17, rows: int = TRAIN_ROWS, rounds: int = ROUNDS, cells: int | None = None) -> Model:
    """Centres and code books of ``vectors``(semantic_id, embedding), learned on at most ``rows`` of them.

    An empty table gives one cell and one code.
    """
    count = vectors.count()
    cells = cells or min(MAX_CELLS, max(1, math.isqrt(count)))
    order = [hash60(F.lit(seed), F.col("semantic_id")), "semantic_id"]
    chosen = vectors.select("semantic_id", "embedding").orderBy(*order).limit(rows)
    sample = written(chosen.repartition(_tasks(vectors.sparkSession)), "sample")
    first = sample.orderBy(*order).limit(max(cells, CODES)).collect()
    if not first:
        return Model(np.zeros((1, GROUP)), np.zeros((1, 1, GROUP)))
    start = np.array([r["embedding"] for r in first], np.float64)
    start /= np.linalg.norm(start, axis=1, keepdims=True)
    groups = [start[:cells]]
    for _ in range(rounds):
        groups = _improved(sample, groups, None)
    width = start.shape[1]
    model = Model(groups[0], np.zeros((-(-width // GROUP), 1, GROUP)))
    books = [np.ascontiguousarray(b) for b in _grouped(start[:CODES] - groups[0][model.cells(start[:CODES])], model)]
    for _ in range(rounds):
        books = _improved(sample, books, model)
    return Model(groups[0], np.stack(books))


def _tasks(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


# --------------------------------------------------------------------- building
@dataclass
class VectorIndex:
    """A stored index: named vectors, their packed blocks, how large each scope is, and the model."""

    names: DataFrame  # semantic_id, concept, term, normalized_term, language, identity, embedding, block
    blocks: DataFrame  # language, block, and the block's rows packed into binary columns
    sizes: DataFrame  # scope (a language, * for all), size, blocks
    model: Model


_PACKED = T.StructType(
    [T.StructField("language", T.StringType()), T.StructField("block", T.LongType()), T.StructField("rows", T.LongType())]
    + [T.StructField(n, T.BinaryType()) for n in ("ids", "identities", "cells", "codes", "bytes", "scales", "slack", "full")]
)


def _coded(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = model.cells(_units(batch.column(batch.schema.get_field_index("embedding"))))
                yield batch.append_column("cell", pa.array(cells.astype(np.int32)))

    return run


def _pack(model: Model):
    """One block's rows as one row, in the order of cells and ids."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("semantic_id", "ascending")]).combine_chunks()
        column = lambda n: table.column(n).combine_chunks() if table.column(n).num_chunks != 1 else table.column(n).chunk(0)
        given, cells = _rows(column("embedding")), column("cell").to_numpy()
        unit = given / np.linalg.norm(given, axis=1, keepdims=True)
        codes = model.codes(unit - model.centres[cells])
        scales = np.abs(unit).max(axis=1) / 127
        small = np.rint(unit / scales[:, None])
        slack = np.linalg.norm(unit - small * scales[:, None], axis=1)
        values = [
            column("semantic_id").to_numpy().astype("<i8"), column("identity").to_numpy().astype("<i8"), cells.astype("<i4"),
            codes.astype("u1"), small.astype("i1"), scales.astype("<f8"), slack.astype("<f8"), given.astype("<f4"),
        ]
        packed = [pa.array([v.tobytes()], pa.binary()) for v in values]
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([len(given)]), *packed], names=_PACKED.names)

    return run


_MODEL = "kind string, part int, number int, numbers array<double>"


def _model_rows(model: Model) -> list[tuple]:
    rows = [("centre", 0, k, c.tolist()) for k, c in enumerate(model.centres)]
    return rows + [("code", g, k, c.tolist()) for g, book in enumerate(model.books) for k, c in enumerate(book)]


def open_index(spark: SparkSession, folder: str) -> VectorIndex:
    """The index that ``build_index`` wrote to ``folder``."""
    told = sorted(spark.read.parquet(f"{folder}/model").collect(), key=lambda r: (r["part"], r["number"]))
    centres = np.array([r["numbers"] for r in told if r["kind"] == "centre"])
    codes = [r for r in told if r["kind"] == "code"]
    groups = 1 + max(r["part"] for r in codes)
    books = np.array([r["numbers"] for r in codes]).reshape(groups, len(codes) // groups, -1)
    return VectorIndex(*(spark.read.parquet(f"{folder}/{n}") for n in ("names", "blocks", "sizes")), Model(centres, books))


def build_index(corpus: Corpus, folder: str | None = None, seed: int = 17, model: Model | None = None) -> VectorIndex:
    """Train (unless a model is given), code and file all vectors of a corpus; everything is written.

    Without a ``folder`` the index goes to one of its own in the shared folder; ``open_index``
    reads it again.

    A block holds about ``BLOCK_ROWS`` vectors of one language in neighbouring cells. A cell
    that holds much of a language is dealt over several blocks by a hash of the vector ids, so
    no block grows with a cell. Vectors of no length are left out (``named_vectors``).
    """
    found = written(named_vectors(corpus), "vectors")
    folder = folder or f"{shared_folder(found.sparkSession)}/index-{uuid.uuid4().hex}"
    model = model or train(found, seed)
    coded = found.mapInArrow(_coded(model), T.StructType([*found.schema.fields, T.StructField("cell", T.IntegerType())]))
    coded = written(coded, "cells")
    # one row per language and cell, at most as many as there are cells in the window
    held = coded.groupBy("language", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("language").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    spans = held.select(
        "language", "cell", F.floor(start / BLOCK_ROWS).alias("first"),
        F.floor((start + F.col("n") - 1) / BLOCK_ROWS).alias("last"),
    )
    filed = coded.join(spans, ["language", "cell"]).withColumn(
        "block", F.col("first") + F.pmod(F.xxhash64("semantic_id"), F.col("last") - F.col("first") + 1)
    ).drop("first", "last")
    filed = written(filed, "names", folder)
    parts = filed.select("language", "block", "cell", "semantic_id", "identity", "embedding")
    blocks = written(parts.groupBy("language", "block").applyInArrow(_pack(model), _PACKED), "blocks", folder)
    scoped = blocks.select(F.explode(F.array("language", F.lit("*"))).alias("scope"), "rows")
    sizes = written(scoped.groupBy("scope").agg(F.sum("rows").alias("size"), F.count(F.lit(1)).alias("blocks")), "sizes", folder)
    written(found.sparkSession.createDataFrame(_model_rows(model), _MODEL), "model", folder)
    return VectorIndex(filed, blocks, sizes, model)


# -------------------------------------------------------------------- searching
_KINDS = {"ids": "<i8", "identities": "<i8", "cells": "<i4", "codes": "u1", "bytes": "i1", "scales": "<f8", "slack": "<f8", "full": "<f4"}
_READ = {True: ["ids", "identities", "cells", "codes", "full"], False: ["ids", "identities", "bytes", "scales", "slack", "full"]}


def _unpacked(block: pa.Table, at: int, names: list[str]) -> dict[str, np.ndarray]:
    own = {n: np.frombuffer(block.column(n)[at].as_py(), _KINDS[n]) for n in names}
    rows = len(own["ids"])
    return {n: v.reshape(rows, -1) if n in ("codes", "bytes", "full") else v for n, v in own.items()}


_HITS = "question string, semantic_id long, identity long, similarity double, scored long"


def _wanted(scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mask of the best ``counts`` finite scores of each row, and all that equal the last of them."""
    rows = scores.shape[1]
    place = rows - np.clip(counts, 1, min(int(counts.max(initial=1)), rows))
    edge = np.partition(scores, np.unique(place), axis=1)[np.arange(len(scores)), place]
    return (scores >= edge[:, None]) & np.isfinite(scores)


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few places where a mask is set, found by eight at a time."""
    flat = np.ascontiguousarray(mask).reshape(-1)
    even = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:even].view(np.uint64))
    near = (words[:, None] * 8 + np.arange(8)).reshape(-1)
    at = np.concatenate((near[flat[near]], even + np.flatnonzero(flat[even:])))
    return np.divmod(at, mask.shape[1])


def _counts(mask: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(row) for row in mask], np.int64)


class _Block:
    """The rows of one block, ready to be scored by tiles of queries."""

    def __init__(self, own: dict[str, np.ndarray], model: Model, by_codes: bool) -> None:
        self.ids, self.identities, self.cells = own["ids"], own["identities"], own.get("cells")
        self.full = own["full"].astype(np.float64)
        self.full /= np.linalg.norm(self.full, axis=1, keepdims=True)
        self.single = self.full.astype(np.float32)
        if by_codes:
            self.coded = model.decoded(own["cells"], own["codes"]).astype(np.float32)
        else:
            self.coded = (own["bytes"] * own["scales"][:, None]).astype(np.float32)
            self.slack = (own["slack"] + _ROUNDING).astype(np.float32)
        self.order = np.argsort(self.identities, kind="stable")
        self.sorted = self.identities[self.order]
        heads = np.flatnonzero(np.diff(self.sorted, prepend=self.sorted[0] - 1))
        self.heads = None if len(heads) == len(self.ids) else heads

    def own_places(self, identity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tile rows and block places that have the identity of the row's query."""
        first = np.searchsorted(self.sorted, identity)
        many = np.searchsorted(self.sorted, identity, "right") - first
        row = np.repeat(np.arange(len(identity)), many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        return row, self.order[first[row] + nth]

    def least(self, scores: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """The ``keep``-th best score of each row, every identity counted once."""
        best = scores if self.heads is None else np.maximum.reduceat(scores[:, self.order], self.heads, axis=1)
        most = min(max(int(keep.max(initial=1)), 1), best.shape[1])
        tail = np.sort(np.partition(best, best.shape[1] - most, axis=1)[:, best.shape[1] - most :], axis=1)
        return np.where(keep <= most, tail[np.arange(len(best)), most - np.clip(keep, 1, most)], -np.inf)

    def hopeful(self, exact: np.ndarray, floor: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Mask of what single-precision scores leave open: no less than ``floor`` or, without one, than the last of the best."""
        low = floor - _ROUNDING
        new = ~np.isfinite(floor)
        if new.any():
            low[new] = self.least(exact[new], keep[new]) - 2 * _ROUNDING
        mask = exact >= low.astype(np.float32)[:, None]
        if not np.isfinite(low).all():
            mask &= np.isfinite(exact)
        return mask


def _searched(model: Model, visited: float, rescored: float | None, counted: bool = True):
    """Best neighbours of the queries of a slice within the blocks of a cell.

    With ``rescored`` the product codes of the visited cells choose what is scored in full;
    without it all rows whose bytes, within their bound of error, may be among the best.
    Codes and full vectors are multiplied alike where a block is mostly chosen, so a share is
    chosen the other way round: rows whose full score is among the best are put in order if
    their codes are among the chosen. A query's best so far bounds what later blocks look at.
    How many rows were chosen is told if they are to be ``counted``, which takes one block a cell.
    """
    probes = max(1, math.ceil(visited * len(model.centres)))

    def by_codes(block: _Block, query: np.ndarray, tile: dict[str, np.ndarray], floor: np.ndarray) -> tuple:
        keep, rows = tile["keep"], len(block.ids)
        single = query.astype(np.float32)
        coded, exact = single @ block.coded.T, single @ block.single.T
        own = block.own_places(tile["identity"])
        coded[own] = exact[own] = -np.inf
        if probes < len(model.centres):
            near = query @ model.centres.T
            cut = np.partition(near, near.shape[1] - probes, axis=1)[:, near.shape[1] - probes]
            unseen = (near < cut[:, None])[:, block.cells]
            coded[unseen] = exact[unseen] = -np.inf
        counts = np.maximum(np.floor(rescored * rows), np.ceil(2 * keep * rows / tile["size"])).astype(np.int64)
        counts = np.clip(counts, 1, rows)
        scored = np.zeros(len(query), np.int64)
        mask = block.hopeful(exact, floor, keep)
        row, place = _places(mask)
        if counted:
            doubt = np.arange(len(query))
        else:
            # where no more rows than are chosen reach the lowest code score of these, all of these are chosen
            lowest = np.full(len(query), np.inf, np.float32)
            np.minimum.at(lowest, row, coded[row, place])
            doubt = np.flatnonzero(_counts(coded >= lowest[:, None]) > counts)
        if len(doubt):
            chosen = _wanted(coded[doubt], counts[doubt])
            scored[doubt] = _counts(chosen)
            left = np.where(chosen, exact[doubt], np.float32(-np.inf))
            mask[doubt] = block.hopeful(left, floor[doubt], keep[doubt]) & chosen
            row, place = _places(mask)
        return row, place, scored

    def by_bytes(block: _Block, query: np.ndarray, tile: dict[str, np.ndarray], floor: np.ndarray) -> tuple:
        single = query.astype(np.float32)
        scores = single @ block.coded.T
        scores[block.own_places(tile["identity"])] = -np.inf
        low = floor.copy()
        new = ~np.isfinite(floor)
        if new.any():
            low[new] = block.least(scores[new] - block.slack[None, :], tile["keep"][new])
        mask = scores + block.slack[None, :] >= (low - _ROUNDING).astype(np.float32)[:, None]
        if not np.isfinite(low).all():
            mask &= np.isfinite(scores)
        scored = _counts(mask)
        if scored.sum() > _MANY * mask.size:
            # one product for all of them; what cannot be among the best is not put in order
            exact = np.where(mask, single @ block.single.T, np.float32(-np.inf))
            mask &= block.hopeful(exact, floor, tile["keep"])
        return *_places(mask), scored

    choose = by_bytes if rescored is None else by_codes

    def better(best: dict[str, np.ndarray], keep: np.ndarray) -> dict[str, np.ndarray]:
        """The ``keep`` best of each row, the best of every identity."""
        row, ids, identity, similarity = (best[n] for n in ("row", "ids", "identity", "similarity"))
        order = np.lexsort((ids, -similarity, identity, row))
        new = np.concatenate(([True], (np.diff(row[order]) != 0) | (np.diff(identity[order]) != 0)))[: len(order)]
        order = order[new]
        order = order[np.lexsort((ids[order], -similarity[order], row[order]))]
        nth = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        kept = order[nth < keep[row[order]]]
        return {n: v[kept] for n, v in best.items()}

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not blocks.num_rows or not asked.num_rows:
            return pa.table({n.split()[0]: [] for n in _HITS.split(", ")})
        tiles = []
        for low in range(0, asked.num_rows, _TILE):
            part = asked.slice(low, _TILE).combine_chunks()
            tile = {n: part.column(n).chunk(0).to_numpy() for n in ("identity", "keep", "size")}
            none = {"row": np.zeros(0, np.int64), "ids": np.zeros(0, np.int64), "identity": np.zeros(0, np.int64)}
            tile["best"] = none | {"similarity": np.zeros(0), "scored": np.zeros(0, np.int64)}
            tiles.append(tile | {"query": _units(part.column("embedding").chunk(0)), "question": part.column("question").chunk(0)})
        for at in range(blocks.num_rows):
            block = _Block(_unpacked(blocks, at, _READ[rescored is not None]), model, rescored is not None)
            for tile in tiles:
                query, keep, best = tile["query"], tile["keep"], tile["best"]
                # the last of the best so far, where there are as many as are to be kept
                ends = np.searchsorted(best["row"], np.arange(len(query)), "right")
                full = (np.bincount(best["row"], minlength=len(query)) >= keep) & (keep > 0)
                floor = np.full(len(query), -np.inf)
                floor[full] = best["similarity"][ends[full] - 1]
                row, place, scored = choose(block, query, tile, floor)
                similarity = np.clip(np.einsum("ij,ij->i", query[row], block.full[place]), -1.0, 1.0)
                new = {
                    "row": row, "ids": block.ids[place], "identity": block.identities[place],
                    "similarity": similarity, "scored": scored[row],
                }
                if len(row):
                    tile["best"] = better({n: np.concatenate((best[n], new[n])) for n in best}, keep)
        parts = [
            pa.table(
                {
                    "question": t["question"].take(pa.array(t["best"]["row"])), "semantic_id": t["best"]["ids"],
                    **{n: t["best"][n] for n in ("identity", "similarity", "scored")},
                }
            )
            for t in tiles
        ]
        return pa.concat_tables(parts)

    return run


def _slices(queries: Column) -> Column:
    few = F.least(F.ceil(queries / QUERY_ROWS), F.lit(FEW_SLICES).cast("long"))
    return F.greatest(few, F.ceil(queries / MOST_QUERY_ROWS))


def _hits(
    index: VectorIndex, questions: DataFrame, visited: float, rescored: float | None, counted: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Best rows per question and cell; the questions. Counted, a cell has one block and hits tell how many of its rows were scored in full."""
    seeds = first_per(
        index.names.select(
            F.col("normalized_term").alias("word"), F.col("language").alias("source_language"),
            "semantic_id", "identity", "embedding",
        ),
        ["word", "source_language"], ["semantic_id"],
    ).drop("semantic_id")
    asked = questions.join(seeds, ["word", "source_language"]).select(
        F.col(Q).cast("string").alias("question"), "identity", "embedding", F.col("limit").cast("long").alias("keep"),
        "min_similarity", F.coalesce("target_language", F.lit("*")).alias("scope"), F.col(Q).alias("asked"),
    )
    scoped = asked.join(index.sizes.drop("blocks"), "scope")
    # slices of the queries of a scope, each for every block of the scope; the blocks (a short row each) by so many a cell
    loads = asked.groupBy("scope").agg(_slices(F.count(F.lit(1))).alias("slices")).join(index.sizes.drop("size"), "scope")
    many = F.floor(F.col("slices") * F.col("blocks") / (_CELLS_PER_TASK * _tasks(index.blocks.sparkSession)))
    some = F.lit(1) if counted else F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), many))
    nth = F.row_number().over(Window.partitionBy("scope").orderBy("language", "block"))
    met = index.blocks.select("language", "block").withColumn(
        "scope", F.explode(F.array("language", F.lit("*")))
    ).withColumn("nth", nth).join(loads, "scope").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    cell = F.concat_ws("/", "scope", "slice", F.floor((F.col("nth") - 1) / some)).alias("cell")
    met = met.select("scope", "slice", "language", "block", cell)
    queries = scoped.join(loads.drop("blocks"), "scope").withColumn("slice", F.pmod(F.xxhash64("question"), F.col("slices"))).join(
        met.select("scope", "slice", "cell").distinct(), ["scope", "slice"]
    ).select(F.col("cell").alias("of_cell"), "question", "identity", "embedding", "keep", "size")
    stored = index.blocks.join(met.select("language", "block", "cell"), ["language", "block"]).select(
        "cell", *_READ[rescored is not None]
    )
    found = stored.groupBy("cell").cogroup(queries.groupBy("of_cell")).applyInArrow(
        _searched(index.model, visited, rescored, counted), _HITS
    )
    return found, asked


def _search(
    index: VectorIndex, requests: DataFrame, visited: float, rescored: float | None, already_distinct: bool, decimals: int
) -> DataFrame:
    requests = with_defaults(requests, NEIGHBOUR_DEFAULTS)

    def answer(questions: DataFrame) -> DataFrame:
        found, asked = _hits(index, questions, visited, rescored)
        order = [F.desc("similarity"), "semantic_id"]
        limits = asked.select("question", F.col("asked").alias(Q), "keep", "min_similarity")
        # identities differ between languages, so one lies in blocks of one language only;
        # a question's hits are shuffled once for all that follows
        unique = first_per(found.drop("scored").repartition("question"), ["question", "identity"], order)
        ranked = top_k(unique.join(limits, "question"), ["question"], order, MAX_BUDGET, F.col("keep")).filter(
            F.col("min_similarity").isNull() | (F.col("similarity") >= F.col("min_similarity"))
        )
        names = index.names.select("semantic_id", "concept", "term", "normalized_term", "language")
        return ranked.join(names, "semantic_id").select(
            Q, "rank", "semantic_id", "concept", "term", "normalized_term", "language",
            F.round("similarity", decimals).alias("similarity"), F.lit("unsensed").alias("sense_scope"),
        )

    return answer_shared(requests, ["word", *NEIGHBOUR_DEFAULTS], answer, already_distinct)


def indexed_neighbours(
    index: VectorIndex, requests: DataFrame, visited: float = 1.0, rescored: float = RESCORED,
    already_distinct: bool = False, decimals: int = 6,
) -> DataFrame:
    """Approximate neighbours: product codes choose, full vectors rank.

    Of every block at most the share ``rescored`` is scored in full, or what twice the limit is
    of the scope where that is more. ``visited`` is the share of the cells, nearest to the
    query first, whose codes are read. Columns and rules are those of ``vectors.neighbours``.
    """
    return _search(index, requests, visited, rescored, already_distinct, decimals)


def bounded_neighbours(
    index: VectorIndex, requests: DataFrame, already_distinct: bool = False, decimals: int = 6
) -> DataFrame:
    """Exact neighbours with few full scores.

    A score from whole-byte codes is off by at most the length of what coding took from the
    vector. Rows whose score plus that bound reaches the limit-th best score less its bound
    are scored in full; no other row can be in the answer.
    """
    return _search(index, requests, 1.0, None, already_distinct, decimals)


def scored_share(index: VectorIndex, requests: DataFrame, rescored: float | None, visited: float = 1.0) -> DataFrame:
    """Per question: rows scored in full and rows of its scope."""
    found, asked = _hits(index, with_defaults(requests, NEIGHBOUR_DEFAULTS), visited, rescored, counted=True)
    told = found.join(index.names.select("semantic_id", "language", "block"), "semantic_id").groupBy(
        "question", "language", "block"
    ).agg(F.max("scored").alias("scored"))
    sums = told.groupBy("question").agg(F.sum("scored").alias("scored"))
    return asked.join(index.sizes.drop("blocks"), "scope").join(sums, "question", "left").select(
        F.col("asked").alias(Q), "scope", F.coalesce("scored", F.lit(0)).alias("scored"), "size"
    )


def index_report(corpus: Corpus, index: VectorIndex, per_language: int, k: int, again: VectorIndex | None = None) -> DataFrame:
    """Per scope: does the approximate search meet the bar of recall, and how much does it score in full?

    Columns: index_scope (global, language), seeds, mean_recall, scored_share, passed,
    deterministic (a search of ``again``, an index of the same vectors in another order,
    gives the same rows), strict_language_filtering.
    """
    seeds = recall_seeds(corpus, per_language).select(
        F.col("normalized_term").alias("word"), F.col("language").alias("source_language"), "semantic_id"
    )
    requests = written(
        seeds.withColumn("index_scope", F.explode(F.array(F.lit("global"), F.lit("language")))).select(
            F.concat_ws("/", "index_scope", "semantic_id").alias(Q), "word", "source_language", "index_scope",
            F.when(F.col("index_scope") == "language", F.col("source_language")).alias("target_language"),
            F.lit(k).alias("limit"),
        ),
        "requests",
    )
    asked = requests.drop("index_scope")
    key = [Q, "language", "normalized_term"]
    truth = neighbours(corpus, asked, already_distinct=True).select(*key)
    found = written(indexed_neighbours(index, asked, already_distinct=True).select(*key, "rank", "semantic_id"), "found")
    sizes = truth.groupBy(Q).agg(F.count(F.lit(1)).alias("truth"))
    shared = found.join(truth, key, "left_semi").groupBy(Q).agg(F.count(F.lit(1)).alias("shared"))
    stray = found.join(asked.select(Q, "target_language"), Q).groupBy(Q).agg(
        F.max(F.coalesce(F.col("language") != F.col("target_language"), F.lit(False))).alias("stray")
    )
    share = scored_share(index, asked, RESCORED).select(Q, (F.col("scored") / F.col("size")).alias("share"))
    row = [Q, "rank", "semantic_id"]
    other = indexed_neighbours(again or index, asked, already_distinct=True).select(*row)
    changed = found.select(*row).exceptAll(other).union(other.exceptAll(found.select(*row))).select(Q).distinct()
    report = requests.join(sizes, Q, "left").join(shared, Q, "left").join(stray, Q, "left").join(share, Q, "left").join(
        changed.withColumn("changed", F.lit(True)), Q, "left"
    )
    return report.groupBy("index_scope").agg(
        F.count(F.lit(1)).alias("seeds"),
        F.avg(F.coalesce("shared", F.lit(0)) / F.coalesce("truth", F.lit(1))).alias("mean_recall"),
        F.avg("share").alias("scored_share"),
        (F.avg(F.coalesce("shared", F.lit(0)) / F.coalesce("truth", F.lit(1))) >= RECALL_BAR).alias("passed"),
        F.every(F.col("changed").isNull()).alias("deterministic"),
        F.every(~F.coalesce("stray", F.lit(False))).alias("strict_language_filtering"),
    )
