"""Aligning the tokens that two vocabularies give the same text.

Both tokenizers cover the same bytes, so a text's tokens are two rising lists of byte ends.
They are merged along the merge path: binary searches on evenly spaced diagonals divide the
merge of all texts of a block into pieces of equal work that do not depend on each other,
each piece sorts its own ends and emits where both lists end together, and an end whose two
sides fall into neighbouring pieces is found by comparing the pieces' edges. The common ends
cut each text's tokens into groups and link the two tokens that end there.

Corpus-wide counts of linked id pairs are made from each block's distinct pairs, so a pair
is shuffled once per block, however often it occurs there, and no pair is hot. The counts go
back to the block's dictionary of pairs, and the links are summed where the block lies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .bpe import Bpe
from .common import arrow_map, gather, land, row_slices, text_bytes
from .pieces import binary_array, decimals, pieces

#: Ends that one piece of a merge holds.
PIECE_ENDS = 256
#: Links and documents from which on a block of documents is closed.
BLOCK_LINKS = 1 << 17
#: Bytes of text that are aligned in one pass; a longer single text is one pass of its own.
PASS_BYTES = 1 << 18


@cache
def plain_bpe(path: str) -> Bpe:
    """A byte-level encoder to which the strings of special tokens are plain text."""
    model = Bpe(path)
    if model.drops_space:
        raise ValueError("a byte-level vocabulary is needed")
    model.special = {}
    return model


# ------------------------------------------------------------------------ merge
def merge_path(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of each rising list lie before every ``width``-th place of their merge.

    All diagonals are searched at once; of equal ends that of ``a`` comes first.
    """
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, width), total)
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # closed searches may point past the ends
        one = a[np.minimum(middle, len(a) - 1)]
        two = b[np.clip(diagonal - middle - 1, 0, len(b) - 1)]
        up = open_ & (one <= two)
        low = np.where(up, middle + 1, low)
        high = np.where(open_ & ~up, middle, high)
    return low, diagonal - low


def common_ends(a: np.ndarray, b: np.ndarray, width: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray]:
    """Places in both strictly rising lists of the ends that they share."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    from_a, from_b = merge_path(a, b, width)
    count_a, count_b = np.diff(from_a), np.diff(from_b)
    # every piece has a row of its own; the last one is filled up
    ends = np.full(len(count_a) * width, np.iinfo(np.int64).max)
    base = np.arange(len(count_a)) * width
    ends[gather(base, count_a)] = 2 * a
    ends[gather(base + count_a, count_b)] = 2 * b + 1
    rows = np.sort(ends.reshape(-1, width), axis=1)
    merged = rows.ravel()
    of_a = merged & 1 == 0
    shared = np.zeros(len(merged), bool)
    inside = shared.reshape(-1, width)
    inside[:, :-1] = rows[:, :-1] + 1 == rows[:, 1:]
    # ends that two neighbouring pieces share between them
    inside[:-1, -1] = rows[:-1, -1] + 1 == rows[1:, 0]
    at = np.flatnonzero(shared & of_a)
    before = from_a[at // width] + (np.cumsum(of_a) - of_a)[at] - (np.cumsum(of_a) - of_a)[at // width * width]
    return before, at - before


# ----------------------------------------------------------------------- blocks
class _Block:
    """What the documents of one block give: rows, and links as places in a dictionary of pairs."""

    def __init__(self) -> None:
        self.rows: list[list[pa.Array]] = []
        self.pairs: list[np.ndarray] = []
        self.size = 0

    def add(self, columns: list[pa.Array], pairs: np.ndarray) -> None:
        self.rows.append(columns)
        self.pairs.append(pairs)
        self.size += len(pairs) + len(columns[0])

    def record(self, number: int, fields: list[pa.Field]) -> pa.RecordBatch:
        columns = [pa.concat_arrays(parts) for parts in zip(*self.rows, strict=True)]
        docs = pa.StructArray.from_arrays(columns, fields=fields)
        distinct, places, times = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), one(docs), pa.array([places.astype("<u4").tobytes()], pa.binary()),
                one(pa.array(distinct, pa.int64())), one(pa.array(times, pa.int64())),
            ],
            names=["block", "docs", "links", "pairs", "times"],
        )


_LONGS = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


def _aligned(texts: pa.Array, path_a: str, path_b: str):
    """Ids of both vocabularies and common ends for the texts that both spell alike.

    Yields per slice of rows: first, last, ids and row starts of both, places of the common ends.
    """
    a_model, b_model = plain_bpe(path_a), pieces(path_b)
    raw, offsets = text_bytes(pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
    for first, last in row_slices(offsets, PASS_BYTES):
        own, starts = raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        rows = last - first
        column = pa.Array.from_buffers(
            pa.string(), rows, [None, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(own.tobytes())]
        )
        parts = [(ids, bounds) for _, _, ids, bounds in a_model.encode(column)]
        a_ids = np.concatenate([ids for ids, _ in parts]).astype(np.int64)
        a_counts = np.concatenate([np.diff(bounds) for _, bounds in parts])
        bare = np.delete(own, starts[:-1])
        b_ids, b_bounds = b_model.encode_block(bare, starts - np.arange(rows + 1))
        b_ids, b_counts = b_ids.astype(np.int64), np.diff(b_bounds)
        a_bounds = np.concatenate(([0], np.cumsum(a_counts)))
        a_spelled, a_sizes = a_model.decode(a_ids, np.arange(len(a_ids) + 1))
        b_sizes = np.concatenate(([0], np.cumsum(b_model.token_lengths[b_ids])))
        b_spelled = b_model.token_spelling(b_ids)
        fit = np.diff(starts) > 1
        for spelled, ends in ((a_spelled, a_sizes[a_bounds]), (b_spelled, b_sizes[b_bounds])):
            fit &= np.diff(ends) == np.diff(starts)
            if len(spelled) == len(own) and np.array_equal(spelled, own):
                continue
            whole, given = spelled.tobytes(), own.tobytes()
            for k in np.flatnonzero(fit):
                fit[k] = whole[ends[k] : ends[k + 1]] == given[starts[k] : starts[k + 1]]
        result = []
        for ids, counts, bounds, sizes in ((a_ids, a_counts, a_bounds, a_sizes), (b_ids, b_counts, b_bounds, b_sizes)):
            kept = np.repeat(fit, counts)
            shift = np.repeat(starts[:-1] - sizes[bounds[:-1]], counts)
            counts = np.where(fit, counts, 0)
            result.append((ids[kept], np.concatenate(([0], np.cumsum(counts))), (sizes[1:] + shift)[kept]))
        (a_ids, a_bounds, a_ends), (b_ids, b_bounds, b_ends) = result
        yield first, last, a_ids, a_bounds, b_ids, b_bounds, *common_ends(a_ends, b_ends)


def _written(a_ids, a_bounds, b_ids, b_bounds, a_at, b_at, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups as text, ``a1,a2|b1;a3|b2,b3``, and where each row's starts."""
    a_group = np.repeat(np.arange(len(a_at)), np.diff(a_at, prepend=-1))
    b_group = np.repeat(np.arange(len(b_at)), np.diff(b_at, prepend=-1))
    ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    marks = np.full(len(ids), ord(","), np.uint8)
    a_place = np.arange(len(a_ids)) + np.concatenate(([0], b_at + 1))[a_group]
    b_place = np.arange(len(b_ids)) + (a_at + 1)[b_group]
    ids[a_place], ids[b_place] = a_ids, b_ids
    marks[a_place[a_at]] = ord("|")
    marks[b_place[b_at]] = ord(";")
    ends = a_bounds + b_bounds
    marks[ends[1:][ends[1:] > ends[:-1]] - 1] = 0
    text, starts = decimals(vocabulary).joined(ids, marks)
    return text, starts[ends]


def align_blocks(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """Aligned documents, many in a row: block, docs, links, pairs, times.

    ``docs`` are structs of doc_id, n_a, n_b, n_groups, n_links and groups_sha256 (and with
    ``with_groups`` the groups themselves as text); ``links`` are the places of all their
    links in ``pairs`` (binary, little-endian unsigned 32-bit), ``times`` how often each pair
    is linked in the block, and a pair is the id of B times 2^32 plus the id of A. Write the
    result before using it: the numbers of the blocks are those of the running tasks.

    A is a byte-level vocabulary, applied to a blank and the text; B a merge-type vocabulary,
    which adds that blank itself. Special tokens in texts are plain text. Texts that are null
    or empty, and those that one side does not spell out byte for byte, have no tokens. A null
    doc_id is kept, repeated rows are rows of their own, other columns are ignored.
    """
    texts = ["groups_sha256", "groups"] if with_groups else ["groups_sha256"]
    doc = T.StructType([T.StructField(n, T.LongType()) for n in _LONGS] + [T.StructField(n, T.StringType()) for n in texts])
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(doc)),
            T.StructField("links", T.BinaryType()), T.StructField("pairs", T.ArrayType(T.LongType())),
            T.StructField("times", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.field(n, pa.int64()) for n in _LONGS] + [pa.field(n, pa.string()) for n in texts]
        vocabulary = max(len(plain_bpe(path_a).token_lengths), len(pieces(path_b).token_lengths))
        number = TaskContext.get().partitionId() << 32
        block = _Block()
        for batch in batches:
            given = pc.fill_null(batch.column(1), "")
            for first, last, a_ids, a_bounds, b_ids, b_bounds, a_at, b_at in _aligned(given, path_a, path_b):
                written, starts = _written(a_ids, a_bounds, b_ids, b_bounds, a_at, b_at, vocabulary)
                cut, whole = starts.tolist(), written.tobytes()
                digests = [hashlib.sha256(whole[x:y]).hexdigest() if y > x else "" for x, y in zip(cut, cut[1:])]
                links = np.diff(np.searchsorted(a_at, a_bounds))
                columns = [
                    batch.column(0).slice(first, last - first), pa.array(np.diff(a_bounds), pa.int64()),
                    pa.array(np.diff(b_bounds), pa.int64()), pa.array(links, pa.int64()),
                    pa.array(links, pa.int64()), pa.array(digests, pa.string()),
                ]
                if with_groups:
                    columns.append(binary_array(written, starts).cast(pa.string()))
                block.add(columns, b_ids[b_at] << 32 | a_ids[a_at])
                if block.size >= BLOCK_LINKS:
                    yield block.record(number, fields)
                    number, block = number + 1, _Block()
        if block.rows:
            yield block.record(number, fields)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(arrow_map, run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a_id, b_id, count of links over all blocks, and whether the count is the highest of its b_id.

    The window holds the A ids that one B id meets, at most one row per id of A's vocabulary.
    """
    each = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = each.groupBy("pairs").agg(F.sum("times").alias("count"))
    of_b = counts.withColumn("b_id", F.shiftright("pairs", 32).cast("int"))
    highest = F.max("count").over(Window.partitionBy("b_id"))
    return of_b.select(
        F.col("pairs").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("a_id"), "b_id", "count",
        (F.col("count") == highest).alias("best"),
    )


def align_documents(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups).

    ``n_best`` are the links whose pair has the highest count of all pairs of its B id, ties
    included; ``count_sum`` adds the counts of all links. See ``align_blocks`` for null, empty
    and repeated rows; an empty table gives no rows.
    """
    blocks = land(align_blocks(docs, path_a, path_b, with_groups), "blocks")
    counts = pair_counts(blocks).select(
        (F.shiftleft(F.col("b_id").cast("long"), 32) + F.col("a_id")).alias("pair"), "count", "best"
    )
    each = blocks.select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair"))
    values = each.join(counts, "pair").select("of_block", "place", "count", "best")
    fields = blocks.schema["docs"].dataType.elementType.fields
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    held = {f.name: f for f in fields} | {n: T.StructField(n, T.LongType(), False) for n in ("n_best", "count_sum")}
    schema = T.StructType([held[n] for n in order + (["groups"] if with_groups else [])])

    def run(block: pa.Table, own: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({f.name: [] for f in schema.fields})
        rows = block.column("docs").combine_chunks().flatten()
        rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
        columns = dict(zip(rows.type.names, rows.flatten(), strict=True))
        place = own.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place] = own.column("count").to_numpy()
        best[place] = own.column("best").to_numpy()
        links = np.frombuffer(block.column("links")[0].as_py(), "<u4")
        ends = np.concatenate(([0], np.cumsum(columns["n_links"].to_numpy())))
        for name, values in (("count_sum", count), ("n_best", best)):
            columns[name] = pa.array(np.diff(np.concatenate(([0], np.cumsum(values[links])))[ends]))
        return pa.table({f.name: columns[f.name] for f in schema.fields})

    # a block is one row on the left and its dictionary on the right, both bounded by the block
    whole = blocks.select("block", "docs", "links")
    return whole.groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(run, schema)
