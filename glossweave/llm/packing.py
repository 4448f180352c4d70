"""Best-fit packing of documents into fixed-length sequences, planned on a histogram of lengths.

The plan is made over counts: at most one entry per length, whatever the number of
documents. Best fit takes lengths from long to short; all pieces of one length fill the
open sequences with the least sufficient room first, then new ones. Each planned run says:
pieces of this length with these ranks go into these sequences at this offset. Pieces then
take their slots by their rank within their length, which is the number of pieces of that
length in earlier partitions plus their place in their own.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .bpe import bpe
from .common import arrow_map, land

SEQUENCE_LENGTH = 4096
END_ID = 1

_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("ids_crc32", T.LongType(), False),
        T.StructField("part", T.LongType(), False),
        T.StructField("place", T.LongType(), False),
    ]
)


def token_pieces(
    docs: DataFrame, path: str, length: int = SEQUENCE_LENGTH, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Token pieces of at most ``length`` of every document; only longer documents are cut.

    A document is the ids of its text (null: empty) followed by ``end_id``, so an empty text
    is one piece of one id. ``part`` and ``place`` count the pieces of equal length in their
    partition from 0; they are stable once the result is written. With ``with_ids`` a binary
    column holds the ids as little-endian unsigned 32-bit integers.
    """
    schema = T.StructType(_PIECES.fields + ([T.StructField("ids", T.BinaryType(), False)] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            for first, last, flat, bounds in model.encode(batch.column(1)):
                rows = last - first
                sizes = np.diff(bounds) + 1
                full = np.insert(flat, bounds[1:], np.uint32(end_id)).astype("<u4")
                begin = np.cumsum(sizes) - sizes
                pieces = -(-sizes // length)
                row = np.repeat(np.arange(rows), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * length
                own = np.minimum(sizes[row] - start, length)
                order = np.argsort(own, kind="stable")
                ranked = own[order]
                head = np.searchsorted(ranked, ranked)
                place = np.empty(len(own), np.int64)
                place[order] = seen[ranked] + np.arange(len(own)) - head
                seen += np.bincount(own, minlength=length + 1)
                raw = full.tobytes()
                spans = [(4 * int(a), 4 * int(a + n)) for a, n in zip(begin[row] + start, own, strict=True)]
                columns = [
                    batch.column(0).slice(first, rows).take(pa.array(row)),
                    pa.array(piece.astype(np.int32)), pa.array(start), pa.array(own),
                    pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()),
                    pa.array(np.full(len(own), part, np.int64)), pa.array(place),
                ]
                if with_ids:
                    columns.append(pa.array([raw[a:b] for a, b in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(arrow_map, run, schema)


def plan_best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs of the best-fit plan, as rows (length, first rank, per sequence, first sequence, offset).

    The pieces of one length with ranks from one run's first to the next run's fill its
    sequences one after the other, ``per sequence`` in each, from ``offset`` on. The number
    of runs depends on the number of distinct lengths, not on the counts.
    """
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of sequences with that room
    rooms: list[int] = []  # the rooms of open_, as a heap per length
    runs: list[tuple[int, int, int, int, int]] = []
    fresh = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            open_.setdefault(room, []).append((first, count))

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        rooms = [r for r in open_ if r >= length]
        heapq.heapify(rooms)
        while left and rooms:
            room = heapq.heappop(rooms)
            for first, count in open_.pop(room):
                fit = room // length
                whole = min(count, left // fit)
                if whole:
                    runs.append((length, rank, fit, first, capacity - room))
                    put(room - fit * length, first, whole)
                    left, rank = left - whole * fit, rank + whole * fit
                if whole < count and 0 < left < fit:
                    runs.append((length, rank, left, first + whole, capacity - room))
                    put(room - left * length, first + whole, 1)
                    rank, left, whole = rank + left, 0, whole + 1
                put(room, first + whole, count - whole)
        if left:
            fit = capacity // length
            whole, rest = divmod(left, fit)
            if whole:
                runs.append((length, rank, fit, fresh, 0))
                put(capacity - fit * length, fresh, whole)
            if rest:
                runs.append((length, rank + whole * fit, rest, fresh + whole, 0))
                put(capacity - rest * length, fresh + whole, 1)
            fresh += whole + bool(rest)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """``pieces`` (landed) with ``sequence_id`` and ``offset`` in place of ``part`` and ``place``.

    The histogram that reaches the driver has at most ``length`` rows and the plan a few runs
    per length; both are bounded by the sequence length. No key is gathered anywhere: ranks
    of a length that a third of all pieces share come from counts per partition.
    """
    tally = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tally = land(tally.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_best_fit(counts, length)
    span = 1 << 48  # ranks stay below
    keys = plan[:, 0] * span + plan[:, 1]
    kept = [f for f in pieces.schema.fields if f.name not in ("part", "place")]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("rank ")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, own * span + rank, side="right") - 1
            _, first_rank, fit, sequence, offset = plan[at].T
            nth, inside = np.divmod(rank - first_rank, np.maximum(fit, 1))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence + nth), pa.array(offset + inside * own)], names=schema.names
            )

    # the table of ranks grows with partitions and lengths, so it is never broadcast
    ranked = pieces.join(tally.drop("n").hint("merge"), ["length", "part"]).select(
        *[F.col(f.name) for f in kept], (F.col("place") + F.col("before")).alias("rank ")
    )
    return ranked.transform(arrow_map, run, schema)


def pack_documents(
    docs: DataFrame, path: str, length: int = SEQUENCE_LENGTH, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Place of every token piece of ``docs(doc_id, text)`` in sequences of at most ``length``.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).
    Null text counts as empty; a null doc_id is kept; repeated rows are packed each by
    itself; other columns are ignored; an empty table gives no rows.
    """
    return pack_pieces(land(token_pieces(docs, path, length, end_id, with_ids), "pieces"), length)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, doc_ids and ids, from pieces with ids.

    A group is one sequence, so it never holds more than the sequence length.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"]))).alias("ids_hex"),
    ).select("sequence_id", "n_tokens", "doc_ids", F.unhex("ids_hex").alias("ids"))
