"""Exact deduplication over a cuckoo-filter index of text digests.

The index is kept in buckets by digest. A bucket holds a cuckoo filter of 16-bit
fingerprints and the stored keys: the full digests with the row that stays and the number
of rows. A change to a bucket asks the filter first; what misses is new; what hits is
compared with the stored digests, so a false hit of the filter changes nothing. A filter
that overflows is doubled and rebuilt from the stored keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import land, text_or_empty

#: Rows of one bucket that a task is meant to hold.
BUCKET_KEYS = 100_000
#: Partial groups that the rows of one digest are first reduced to.
SALTS = 16
_WAYS = 4
_KICKS = 200


def normalised(text: Column) -> Column:
    """Each run of blanks, tabs, line and page breaks as one space."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


class CuckooFilter:
    """Fingerprints in two possible bins of four places each; whole arrays at a time."""

    def __init__(self, bins: int, places: np.ndarray | None = None):
        self.bins = bins
        self.places = np.zeros((bins, _WAYS), np.uint16) if places is None else places

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(keys / (_WAYS * 0.8))).bit_length())

    @classmethod
    def read(cls, blob: bytes) -> CuckooFilter:
        places = np.frombuffer(blob, np.uint16).reshape(-1, _WAYS).copy()
        return cls(len(places), places)

    def blob(self) -> bytes:
        return self.places.tobytes()

    def _marks(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and first bin of each 64-bit key."""
        mark = (keys >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (keys & np.uint64(self.bins - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, bin_: np.ndarray) -> np.ndarray:
        return bin_ ^ ((mark.astype(np.int64) * 0x5BD1E995) & (self.bins - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first = self._marks(keys)
        second = self._other(mark, first)
        return ((self.places[first] == mark[:, None]) | (self.places[second] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys that are not in the filter's set; false when it overflows (rebuild it then)."""
        mark, bin_ = self._marks(keys)
        moved = np.zeros(len(keys), bool)
        for kick in range(_KICKS):
            if not mark.size:
                return True
            order = np.argsort(bin_, kind="stable")
            mark, bin_, moved = mark[order], bin_[order], moved[order]
            nth = np.arange(len(bin_)) - np.searchsorted(bin_, bin_)
            free = self.places[bin_] == 0
            fits = nth < free.sum(axis=1)
            # the nth newcomer of a bin takes its nth free place
            way = np.argmax(np.cumsum(free, axis=1) == (nth + 1)[:, None], axis=1)
            self.places[bin_[fits], way[fits]] = mark[fits]
            mark, bin_, moved, nth = mark[~fits], bin_[~fits], moved[~fits], nth[~fits]
            push = moved & (np.concatenate(([True], bin_[1:] != bin_[:-1])))
            victim = (kick + bin_[push]) % _WAYS
            mark[push], self.places[bin_[push], victim] = self.places[bin_[push], victim], mark[push].copy()
            turn = push | ~moved  # a newcomer tries its second bin before it pushes another out
            bin_[turn] = self._other(mark[turn], bin_[turn])
            moved |= turn
        return not mark.size

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted, each once."""
        mark, first = self._marks(keys)
        for m, a, b in zip(mark, first, self._other(mark, first), strict=True):
            for bin_ in (a, b):
                way = np.flatnonzero(self.places[bin_] == m)
                if way.size:
                    self.places[bin_, way[0]] = 0
                    break


def _key(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[8:16] for d in digests), "<u8").astype(np.uint64)


_STATE = "bucket int, filter binary, digest binary, keep struct<gone:boolean,doc_id:bigint,place:bigint>, copies bigint"


def _advance(key, state: pa.Table, changes: pa.Table) -> pa.Table:
    """New state of one bucket after its changes: deletions first, then insertions."""
    rows = {r["digest"]: (r["keep"], r["copies"]) for r in state.to_pylist() if r["digest"] is not None}
    blobs = [b for b in state.column("filter").to_pylist() if b is not None]
    index = CuckooFilter.read(blobs[0]) if blobs else CuckooFilter.sized(len(changes))
    deletes = [r["digest"] for r in changes.to_pylist() if r["deletes"]]
    if deletes:
        hits = index.contains(_key(deletes))
        gone = list(dict.fromkeys(d for d, hit in zip(deletes, hits, strict=True) if hit and d in rows))
        index.remove(_key(gone))
        for d in gone:
            del rows[d]
    added = [r for r in changes.to_pylist() if not r["deletes"]]
    added.sort(key=lambda r: r["nth"])
    first = 0
    while first < len(added):  # a step holds a digest once at most
        last = first
        while last < len(added) and added[last]["nth"] == added[first]["nth"]:
            last += 1
        step = added[first:last]
        hits = index.contains(_key([r["digest"] for r in step]))
        new = []
        for r, hit in zip(step, hits, strict=True):
            held = rows.get(r["digest"]) if hit else None
            if held is None:
                new.append(r["digest"])
                rows[r["digest"]] = (r["keep"], r["copies"])
            else:
                keep = min(held[0], r["keep"], key=lambda k: (k["gone"], k["doc_id"] or 0, k["place"]))
                rows[r["digest"]] = (keep, held[1] + r["copies"])
        while new and not index.insert(_key(new)):
            index, new = CuckooFilter(index.bins * 2), list(rows)
        first = last
    bucket = key[0].as_py()
    return pa.table(
        {
            "bucket": pa.array([bucket] * (len(rows) + 1), pa.int32()),
            "filter": pa.array([index.blob()] + [None] * len(rows), pa.binary()),
            "digest": pa.array([None, *rows], pa.binary()),
            "keep": pa.array(
                [None, *(k for k, _ in rows.values())],
                pa.struct([("gone", pa.bool_()), ("doc_id", pa.int64()), ("place", pa.int64())]),
            ),
            "copies": pa.array([None, *(c for _, c in rows.values())], pa.int64()),
        }
    )


@dataclass
class DigestIndex:
    """Live digests in ``buckets`` buckets, as a table that can be written and read back."""

    state: DataFrame
    buckets: int

    @classmethod
    def empty(cls, spark: SparkSession, keys: int) -> DigestIndex:
        return cls(spark.createDataFrame([], _STATE), max(8, -(-keys // BUCKET_KEYS)))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int")

    def _changed(self, changes: DataFrame) -> DigestIndex:
        changes = changes.withColumn("bucket", self._bucket())
        state = self.state.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInArrow(_advance, _STATE)
        return DigestIndex(land(state, "digests"), self.buckets)

    def insert(self, rows: DataFrame) -> DigestIndex:
        """The index after adding ``rows(digest, doc_id, place)``; place names a row.

        The rows of a digest are reduced to at most ``SALTS`` partial groups before they are
        dealt to buckets, so a digest that a third of all rows share costs its bucket little.
        """
        least = F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", "place")
        salt = F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int")
        partial = rows.groupBy("digest", salt.alias("nth")).agg(
            F.min(least).alias("keep"), F.count(F.lit(1)).alias("copies")
        )
        return self._changed(partial.withColumn("deletes", F.lit(False)))

    def delete(self, digests: DataFrame) -> DigestIndex:
        """The index without the given ``digests(digest)``; digests that are not live are ignored."""
        return self._changed(
            digests.select("digest").where("digest IS NOT NULL").distinct().select(
                "digest", F.lit(0).alias("nth"),
                F.lit(None).cast("struct<gone:boolean,doc_id:bigint,place:bigint>").alias("keep"),
                F.lit(0).cast("long").alias("copies"), F.lit(True).alias("deletes"),
            )
        )

    def entries(self) -> DataFrame:
        """digest, keep (the row that stays) and copies of every live digest."""
        return self.state.where("digest IS NOT NULL").select("digest", "keep", "copies")

    def write(self, path: str) -> None:
        self.state.write.parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, buckets: int) -> DigestIndex:
        return cls(spark.read.schema(_STATE).parquet(path), buckets)


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, SHA-256 of the normalised text (null: empty) and a place, written down."""
    return land(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(F.sha2(normalised(text_or_empty()).cast("binary"), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "digested",
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with its group of equal texts.

    Returns doc_id, keep_id, group_size, kept and text_sha256. Of equal texts the row with
    the smallest doc_id stays, a null doc_id only if there is no other; of rows that repeat
    this doc_id too, exactly one stays. Null text counts as empty; other columns are ignored.
    """
    rows = digest_rows(docs)
    index = DigestIndex.empty(rows.sparkSession, rows.count()).insert(rows)
    entries = index.entries().withColumnRenamed("digest", "digest ")
    joined = rows.join(entries, rows["digest"] == entries["digest "])
    return joined.select(
        rows["doc_id"],
        F.col("keep.doc_id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("place") == F.col("keep.place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text equals that of a row with a smaller doc_id.

    Columns and remaining rows stay as they are. Only ids and digests travel to the index.
    """
    own = F.sha2(normalised(text_or_empty()).cast("binary"), 256)
    rows = digest_rows(docs)
    keep = DigestIndex.empty(rows.sparkSession, rows.count()).insert(rows).entries().select(
        F.lower(F.hex("digest")).alias("sha "), F.col("keep.doc_id").alias("id ")
    )
    # by doc_id and digest no key is hot: a group keeps one row unless its doc_id repeats
    marked = docs.withColumn("own ", own).join(
        keep, F.col("doc_id").eqNullSafe(F.col("id ")) & (F.col("own ") == F.col("sha "))
    )
    return marked.dropDuplicates(["doc_id", "own "]).select(*[docs[f"`{c}`"] for c in docs.columns])
