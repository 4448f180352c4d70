"""What the operators of this package share: reading, landing tables, Arrow text as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import shared_folder

#: Bytes of a batch that a Python worker receives at a time (a longer single row is a batch of its own).
BATCH_BYTES = 4 << 20
#: Bytes of text that one numpy pass works on; a longer single text is one pass of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written rows are fixed: row numbers made before this point cannot change when an
    executor is lost, and later steps start from columns with known sizes.
    """
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes, so that long texts do not swell a worker.

    The bound is a setting of the session; a smaller one that is already set stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(name).strip().lower().removesuffix("b")
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_slices(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows holding at most ``limit`` bytes (one row at least)."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and where each row starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string() and column.type != pa.binary():
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(column) else raw[:0]
    return raw, offsets - offsets[0]


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the row starts counted in code points."""
    first = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    text = raw.tobytes().decode("utf-8", "replace")
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), first[offsets]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all positions of the given ranges, one range after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = {False: np.ones(1, np.uint64), True: np.ones(1, np.uint64)}


def _powers(count: int, inverse: bool) -> np.ndarray:
    have = _POWERS[inverse]
    if len(have) < count:
        size = max(count, BLOCK_BYTES + 1024)
        steps = np.full(size, _INVERSE if inverse else _POWER, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * BLOCK_BYTES:
            _POWERS[inverse] = have
    return have[:count]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of one array: equal ranges have equal hashes wherever they stand."""
    spread = mixed(symbols.astype(np.uint64) + np.uint64(0x1234567))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread * _powers(len(symbols), False), dtype=np.uint64)))
    own = (sums[ends] - sums[starts]) * _powers(len(symbols) + 1, True)[starts]
    return mixed(own + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` consecutive word hashes; ``len(words) - size + 1`` of them."""
    count = len(words) - size + 1
    total = np.zeros(max(count, 0), np.uint64)
    for k in range(size):
        total = mixed(total * _POWER + words[k : k + max(count, 0)])
    return total
