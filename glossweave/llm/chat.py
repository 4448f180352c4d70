"""Chat formatting by columnar byte assembly.

Each turn becomes header, role, line break, text and trailer. Segment lengths, cumulative
offsets and scatter indices are worked out in numpy for a block of turns at once, and
headers and contents are copied into one preallocated buffer that Arrow then holds as the
result column. Control strings inside roles and texts are escaped with a backslash, so that
the control strings of the template occur nowhere else and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import BLOCK_BYTES, arrow_map, gather, row_slices, text_bytes

# fixed values: the marks of a turn
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_ESCAPE, _LESS, _BAR, _LINE = (ord(c) for c in "\\<|\n")

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("formatted", T.StringType(), False),
        T.StructField("loss_start", T.LongType(), False),
        T.StructField("loss_end", T.LongType(), False),
    ]
)


def _escaped(raw: np.ndarray, bounds: np.ndarray, lines: bool) -> tuple[np.ndarray, np.ndarray]:
    """Backslashes doubled, "<|" broken by one; with ``lines`` a line break as backslash and n."""
    extra = raw == _ESCAPE
    bar = np.flatnonzero((raw[1:] == _BAR) & (raw[:-1] == _LESS)) + 1
    starts = np.zeros(len(raw) + 1, bool)
    starts[bounds] = True
    extra[bar[~starts[bar]]] = True
    if lines:
        broken = raw == _LINE
        raw = np.where(broken, np.uint8(ord("n")), raw)
        extra |= broken
    added = np.concatenate(([0], np.cumsum(extra)))
    out = np.full(len(raw) + int(added[-1]), _ESCAPE, np.uint8)
    out[np.arange(len(raw)) + added[1:]] = raw
    return out, bounds + added[bounds]


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns as one Arrow array, and the byte range of each turn's text in its turn."""
    role, role_at = _escaped(*text_bytes(roles), lines=True)
    text, text_at = _escaped(*text_bytes(texts), lines=False)
    head, tail = (np.frombuffer(s.encode(), np.uint8) for s in (START, END + "\n"))
    rows = len(roles)
    lengths = np.empty((rows, 5), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2] = len(head), np.diff(role_at), 1
    lengths[:, 3], lengths[:, 4] = np.diff(text_at), len(tail)
    ends = np.cumsum(lengths.ravel()).reshape(rows, 5)
    begins = ends - lengths
    buffer = np.empty(int(ends[-1, -1]) if rows else 0, np.uint8)
    buffer[begins[:, 0, None] + np.arange(len(head))] = head
    buffer[gather(begins[:, 1], lengths[:, 1])] = role
    buffer[begins[:, 2]] = _LINE
    buffer[gather(begins[:, 3], lengths[:, 3])] = text
    buffer[begins[:, 4, None] + np.arange(len(tail))] = tail
    places = np.concatenate(([0], ends[:, 4])).astype(np.int32)
    column = pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(buffer)])
    return column, begins[:, 3] - begins[:, 0], ends[:, 3] - begins[:, 0]


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, sizes = text_bytes(batch.column(3))
        for first, last in row_slices(sizes, BLOCK_BYTES):
            part = batch.slice(first, last - first)
            column, begin, end = assemble(part.column(2), part.column(3))
            loss = np.array([r == LOSS_ROLE for r in part.column(2).to_pylist()], bool)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), column, pa.array(np.where(loss, begin, 0)), pa.array(np.where(loss, end, 0))],
                names=TURNS.names,
            )


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, its part of the formatted conversation, its loss range.

    A conversation's formatted text is its rows' ``formatted`` in order; the loss range is in
    bytes of the row (0, 0: none) and covers the text of assistant turns. Rows lie in the
    order of turns and a conversation in one partition, however long it is, because its
    digests are sequential; nothing holds it whole. Null roles and texts count as empty. A
    null conv_id is one conversation of its own. Turns that tie, repeats included, are
    ordered by role, then text. Other columns are ignored.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    count = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(count, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.transform(arrow_map, _formatted, TURNS)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    if not formatted.startswith(START) or not formatted.endswith(END + "\n"):
        raise ValueError("not a formatted turn")
    role, _, text = formatted[len(START) : -len(END) - 1].partition("\n")
    return unescaped(role), unescaped(text)


DIGESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType(), False),
        T.StructField("turns_sha256", T.StringType(), False),
        T.StructField("loss_chars", T.LongType(), False),
        T.StructField("loss_sha256", T.StringType(), False),
        T.StructField("formatted_chars", T.LongType(), False),
    ]
)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose turns come one after the other; open state is a few numbers."""
    done: list[tuple] = []
    open_: list | None = None

    def closed(state: list) -> tuple:
        return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array([r[k] for r in rows], pa.string() if k in (2, 4) else pa.int64()) for k in range(6)]
        return pa.RecordBatch.from_arrays(arrays, names=DIGESTS.names)

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in (0, 2, 3, 4)]
        for conv_id, formatted, begin, end in zip(*columns, strict=True):
            if open_ is None or open_[0] != conv_id:
                if open_ is not None:
                    done.append(closed(open_))
                open_ = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_turn(formatted)
            open_[1] += 1
            open_[2].update(f"{role}\n{text}\n".encode())
            if end:
                under = unescaped(formatted.encode()[begin:end].decode())
                open_[3] += len(under)
                open_[4].update(under.encode())
            open_[5] += len(formatted)
        if done:
            yield batch_of(done)
            done = []
    if open_ is not None:
        yield batch_of([closed(open_)])


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted turns read back as; ``formatted`` as made above."""
    return formatted.transform(arrow_map, _read_back, DIGESTS)
