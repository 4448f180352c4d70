"""Digests of sources that depend on the order of the rows, made in parallel.

A run of rows has a digest and a length. Of two neighbouring runs the digests combine to that
of both: the left one times a base to the power of the right one's length, plus the right
one. That is associative, so runs may be cut anywhere: every task digests its own rows, and
runs are combined in the order of the files. No row waits for the one before it, and where a
source is cut into files and tasks leaves no trace.

There are four lanes, each with its own prime below 2^31 and its own base, so that products
fit 64 bits and swapped rows go unseen in all lanes only if their distance is a multiple of
all periods.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LANES = 4
_ORDER = ("file", "block", "at")


def _primes_below(bound: int, count: int) -> list[int]:
    found = []
    while len(found) < count:
        bound -= 1
        if all(bound % d for d in range(2, int(bound**0.5) + 1)):
            found.append(bound)
    return found


PRIMES = _primes_below(1 << 31, LANES)
#: The base of each lane; any number that is no small power of two would do.
BASES = [1_000_003 + 2 * lane for lane in range(LANES)]


def lane_values(text: Column) -> Column:
    """One number below 2^31 per lane out of a row's text; null and empty text differ."""
    framed = F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), text))
    digest = F.sha2(framed, 256)
    return F.array(
        *[
            (F.conv(F.substring(digest, 1 + 15 * lane, 15), 16, 10).cast("bigint") % F.lit(p)).cast("bigint")
            for lane, p in enumerate(PRIMES)
        ]
    )


def _powers(base: int, prime: int, count: int) -> np.ndarray:
    """base^0 … base^(count - 1) modulo prime, by doubling."""
    powers = np.ones(1, np.int64)
    while len(powers) < count:
        powers = np.concatenate((powers, powers * pow(base, len(powers), prime) % prime))
    return powers[:count]


def _run_digest(values: np.ndarray) -> list[int]:
    """Digest of a run of rows (rows × lanes)."""
    rows = len(values)
    return [
        int((values[:, lane] * _powers(BASES[lane], PRIMES[lane], rows)[::-1] % PRIMES[lane]).sum() % PRIMES[lane])
        for lane in range(LANES)
    ]


def _joined(left: tuple[int, list[int]], right: tuple[int, list[int]]) -> tuple[int, list[int]]:
    """Length and digest of two neighbouring runs."""
    n, m = left[0], right[0]
    return n + m, [
        (a * pow(base, m, prime) + b) % prime for a, b, base, prime in zip(left[1], right[1], BASES, PRIMES, strict=True)
    ]


_RUN = "source string, file string, block long, at long, n long, lanes array<long>"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A run per source, file and block of the rows that pass, in their order."""
    open_: tuple | None = None
    done: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        source, file, block = (np.array(batch.column(k).to_pylist(), object) for k in range(3))
        at = batch.column(3).to_pylist()
        values = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, LANES)
        new = (source[1:] != source[:-1]) | (file[1:] != file[:-1]) | (block[1:] != block[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            run = (b - a, _run_digest(values[a:b]))
            if open_ and open_[0] == (source[a], file[a], block[a]):
                open_ = (open_[0], open_[1], _joined(open_[2], run))
            else:
                if open_:
                    done.append(open_)
                open_ = ((source[a], file[a], block[a]), at[a], run)
    yield _told(done + ([open_] if open_ else []))


def _told(runs: list[tuple]) -> pa.RecordBatch:
    columns = [
        pa.array([r[0][0] for r in runs], pa.string()), pa.array([r[0][1] for r in runs], pa.string()),
        pa.array([r[0][2] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.int64()),
        pa.array([r[2][0] for r in runs], pa.int64()), pa.array([r[2][1] for r in runs], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["source", "file", "block", "at", "n", "lanes"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring runs of one source as one, named by the first of them."""
    done: list[tuple] = []
    for batch in batches:
        for r in batch.to_pylist():
            run = (r["n"], r["lanes"])
            if done and done[-1][0][0] == r["source"]:
                done[-1] = (done[-1][0], done[-1][1], _joined(done[-1][2], run))
            else:
                done.append(((r["source"], r["file"], r["block"]), r["at"], run))
    yield _told(done)


def ordered_digest(rows: DataFrame, text: Column, source: Column | None = None, in_order: bool = False) -> DataFrame:
    """source, rows, digest of ``rows``(file, block, at, …), in the order of file, block and at.

    ``in_order`` says that the rows come as ``read_lines`` reads them, each task's in order
    and each block in one task; then nothing is sorted. Otherwise they are dealt to tasks by
    ranges first. Runs are combined per range of files, then the ranges' own few runs. A null
    text is not an empty one; a source without rows is not listed.
    """
    name = F.lit("") if source is None else source.cast("string")
    given = rows.select(
        name.alias("source"), F.col("file").cast("string").alias("file"), F.col("block").cast("long").alias("block"),
        F.col("at").cast("long").alias("at"), lane_values(text).alias("values"),
    )
    if not in_order:
        given = given.repartitionByRange("source", *_ORDER).sortWithinPartitions("source", *_ORDER)
    runs = given.mapInArrow(_digested, _RUN)
    ranged = runs.repartitionByRange("source", *_ORDER).sortWithinPartitions("source", *_ORDER)
    # one run per source and range is left: as many rows as there are tasks
    few = ranged.mapInArrow(_combined, _RUN).coalesce(1).sortWithinPartitions("source", *_ORDER)
    whole = few.mapInArrow(_combined, _RUN)
    return whole.select("source", F.col("n").alias("rows"), F.concat_ws("-", F.col("lanes").cast("array<string>")).alias("digest"))


def changed_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sources whose digest or number of rows differs, or that only one side has."""
    one, two = before.toDF("source", "rows_before", "before"), after.toDF("source", "rows_after", "after")
    joined = one.join(two, "source", "full_outer")
    same = F.col("rows_before").eqNullSafe(F.col("rows_after")) & F.col("before").eqNullSafe(F.col("after"))
    return joined.where(~same)
