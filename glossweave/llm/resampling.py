"""Drawing documents in the likeness of a target by importance weights of hashed word runs.

A document's features are its runs of words, hashed into buckets. A bucket's gain is the
logarithm of its share in the target over its share in the corpus, both smoothed by one; a
document's weight is the mean gain of its features, looked up in one array. A Gumbel number
made of the document's id is added to the weight, so that the highest scores are a draw
without replacement in proportion to the weights.

The cutoff of the draw is found by weighted median-of-medians selection: in every round each
partition reports the median of the keys that are still in question on either side of the
last pivot, and the median of these medians, weighted by how many keys each stands for,
becomes the next pivot. At least a quarter of the keys lies on either side of it, so that
every round discards a guaranteed fraction. Only the winners are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.ranking import global_index
from .common import arrow_map, gather, land, row_slices, text_bytes
from .pieces import binary_array

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
#: Keys in question from which on the selection goes on by rounds; fewer are fetched and sorted.
LAST_KEYS = 10_000
#: Keys in question are written anew when their number has fallen by this factor.
_SHRINK = 8
_LONG_RUN = 48
_MAX = (1 << 63) - 1


@cache
def _crc_table() -> np.ndarray:
    """The CRC-32 table, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def crc32_ranges(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of many ranges of bytes, one byte of all ranges at a time."""
    table, result = _crc_table(), np.zeros(len(starts), np.uint32)
    short = np.flatnonzero(lengths <= _LONG_RUN)
    order = short[np.argsort(-lengths[short], kind="stable")]
    at, left = starts[order], lengths[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -k))  # ranges longer than k come first
        own = state[:live]
        state[:live] = table[(own ^ raw[at[:live] + k]) & 0xFF] ^ (own >> np.uint32(8))
    result[order] = ~state
    for k in np.flatnonzero(lengths > _LONG_RUN):
        result[k] = zlib.crc32(raw[starts[k] : starts[k] + lengths[k]])
    return result


def word_ranges(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, one blank after each; where each starts; its length; words before each row.

    Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII.
    """
    lowered = np.where((raw >= 0x41) & (raw <= 0x5A), raw + np.uint8(0x20), raw)
    inside = (lowered >= 0x80) | ((lowered >= 0x61) & (lowered <= 0x7A)) | ((lowered >= 0x30) & (lowered <= 0x39))
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    start = inside & (first | ~np.concatenate(([False], inside[:-1])))
    end = inside & np.concatenate((first[1:] | ~inside[1:], [True]))[: len(raw)]
    starts, lengths = np.flatnonzero(start), np.flatnonzero(end) - np.flatnonzero(start) + 1
    words = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    places = np.cumsum(lengths + 1) - lengths - 1
    words[gather(places, lengths)] = lowered[gather(starts, lengths)]
    return words, places, lengths, np.searchsorted(starts, offsets)


def feature_buckets(
    raw: np.ndarray, offsets: np.ndarray, buckets: int, shortest: int, longest: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a block of texts, where each row's start, and each row's words.

    Features are the runs of ``shortest`` to ``longest`` consecutive words joined by one blank.
    """
    words, places, lengths, before = word_ranges(raw, offsets)
    ends, row = places + lengths, np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    hashed, owner = [], []
    for size in range(shortest, longest + 1):
        head = np.arange(max(len(places) - size + 1, 0))
        head = head[row[head] == row[head + size - 1]]
        hashed.append(crc32_ranges(words, places[head], ends[head + size - 1] - places[head]) % np.uint32(buckets))
        owner.append(row[head])
    owner, hashed = np.concatenate(owner), np.concatenate(hashed)
    if longest > shortest:
        order = np.argsort(owner, kind="stable")
        owner, hashed = owner[order], hashed[order]
    return hashed, np.searchsorted(owner, np.arange(len(offsets))), np.diff(before)


def hashed_features(
    docs: DataFrame, buckets: int = BUCKETS, shortest: int = 1, longest: int = 1, key: str = "doc_id"
) -> DataFrame:
    """doc_id, n_words, n_features and the buckets of the features (binary, little-endian unsigned 32-bit).

    Null text has no words. Repeated rows stay rows of their own; other columns are ignored.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType(), False),
            T.StructField("n_features", T.LongType(), False), T.StructField("buckets", T.BinaryType(), False),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for first, last in row_slices(offsets):
                own = raw[offsets[first] : offsets[last]]
                hashed, bounds, words = feature_buckets(
                    own, offsets[first : last + 1] - offsets[first], buckets, shortest, longest
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), pa.array(words.astype(np.int64)),
                        pa.array(np.diff(bounds).astype(np.int64)), binary_array(hashed.astype("<u4"), bounds),
                    ],
                    names=schema.names,
                )

    return docs.select(F.col(key).cast("long"), F.col("text").cast("string")).transform(arrow_map, run, schema)


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the whole table each bucket holds.

    Every partition adds its features up before anything is shuffled; at most ``buckets``
    rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, _ = text_bytes(batch.column(0))
            total += np.bincount(np.frombuffer(raw.tobytes(), "<u4"), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    tally = arrow_map(features.select("buckets"), run, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for r in tally.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the logarithm of each bucket's share in the target over that in the corpus."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def _luck(doc_id: int | None, seed: int) -> int:
    """Floored thousandths of a Gumbel number that depends on seed and id only."""
    own = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{own}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(features: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of ``features``.

    The weight is the floored mean of the features' gains, 0 without features. A null doc_id
    draws as an empty one.
    """
    schema = "doc_id long, n_words long, n_features long, weight long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(3))
            own = gains[np.frombuffer(raw.tobytes(), "<u4")]
            sums = np.concatenate(([0], np.cumsum(own)))[offsets // 4]
            weight = np.diff(sums) // np.maximum(np.diff(offsets) // 4, 1)
            luck = np.array([_luck(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(weight), pa.array(weight + luck)],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return arrow_map(features.select("doc_id", "n_words", "n_features", "buckets"), run, schema)


# ------------------------------------------------------------------- selection
Key = tuple[int, int, int]


def _middle(keys: np.ndarray) -> Key:
    """The lower median of rows of three numbers, compared from the first on."""
    rank = (len(keys) - 1) // 2
    for k in range(3):
        value = np.partition(keys[:, k], rank)[rank]
        rank -= int((keys[:, k] < value).sum())
        keys = keys[keys[:, k] == value]
    return tuple(keys[0].tolist())


def _below(keys: np.ndarray, bound: Key) -> np.ndarray:
    a, b, c = bound
    x, y, z = keys.T
    return (x < a) | ((x == a) & ((y < b) | ((y == b) & (z < c))))


def _before(bound: Key) -> Column:
    a, b, c = (F.lit(n).cast("long") for n in bound)
    x, y, z = F.col("k0"), F.col("k1"), F.col("k2")
    return (x < a) | ((x == a) & ((y < b) | ((y == b) & (z < c))))


def _report(keys: DataFrame, pivot: Key | None) -> list[tuple[int, Key]]:
    """Per partition and side of the pivot: how many keys there are, and their median.

    Side 0 holds the keys before the pivot, side 1 those after it (all, without a pivot).
    Two rows a partition reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows]
        if not held:
            return
        own = np.concatenate(held)
        if pivot is None:
            sides = [own[:0], own]
        else:
            low = _below(own, pivot)
            sides = [own[low], own[~low & (own != np.array(pivot)).any(axis=1)]]
        rows = [(k, len(side), *_middle(side)) for k, side in enumerate(sides) if len(side)]
        if rows:
            names = ["side", "n", "k0", "k1", "k2"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    found = arrow_map(keys.select("k0", "k1", "k2"), run, "side long, n long, k0 long, k1 long, k2 long").collect()
    return [(r["side"], r["n"], (r["k0"], r["k1"], r["k2"])) for r in found]


def _weighted_middle(medians: list[tuple[int, Key]]) -> Key:
    """The median where at least half of the weight lies at or before it."""
    half, passed = sum(n for n, _ in medians), 0
    for n, key in sorted(medians, key=lambda m: m[1]):
        passed += n
        if 2 * passed >= half:
            return key
    raise ValueError("no keys")


def select_key(keys: DataFrame, count: int, last_keys: int = LAST_KEYS) -> Key | None:
    """The ``count``-th smallest of the distinct keys (k0, k1, k2); None if that is before the first.

    ``keys`` must be a written table. Each round is one pass over the keys still in question
    that gives two rows a partition; a round leaves at most three quarters of them. At most
    ``last_keys`` keys are fetched in the end.
    """
    if count < 1:
        return None
    base, low, high = keys, None, None  # keys in question: those of base strictly between low and high

    def question() -> DataFrame:
        own = base if low is None else base.where(~_before((low[0], low[1], low[2] + 1)))
        return own if high is None else own.where(_before(high))

    report = _report(base, None)
    left, wanted = sum(n for _, n, _ in report), count
    written = left
    if wanted > left:
        raise ValueError(f"only {left} keys")
    medians = [(n, key) for _, n, key in report]
    while left > last_keys:
        pivot = _weighted_middle(medians)
        report = _report(question(), pivot)
        below = sum(n for side, n, _ in report if side == 0)
        if wanted == below + 1:
            return pivot
        after = wanted > below
        medians = [(n, key) for side, n, key in report if side == after]
        if after:
            low, wanted, left = pivot, wanted - below - 1, left - below - 1
        else:
            high, left = pivot, below
        if left * _SHRINK <= written:
            base, low, high, written = land(question(), "keys"), None, None, left
    rest = sorted((r["k0"], r["k1"], r["k2"]) for r in question().collect())
    return rest[wanted - 1]


def draw(scored: DataFrame, share: tuple[int, int] = (10, 100), min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the highest scores, null for rows not drawn.

    Of the rows with at least ``min_words`` words the given share is drawn, rounded down. Ties
    go to the smaller doc_id, null last, and then to the earlier row. An empty table gives no
    rows.
    """
    numbered = land(scored.withColumn("row ", F.monotonically_increasing_id()), "scores")
    keyed = numbered.withColumns(
        {"k0": -F.col("score"), "k1": F.coalesce("doc_id", F.lit(_MAX)), "k2": F.col("row ")}
    )
    able = F.col("n_words") >= min_words
    count = numbered.where(able).count() * share[0] // share[1]
    cutoff = select_key(keyed.where(able).select("k0", "k1", "k2"), count)
    added = ["k0", "k1", "k2", "row "]
    no_rank = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return numbered.drop("row ").select("*", no_rank)
    drawn = able & _before((cutoff[0], cutoff[1], cutoff[2] + 1))
    winners = global_index(keyed.where(drawn), ["k0", "k1", "k2"], "rank")
    winners = winners.withColumn("rank", F.col("rank") + 1).drop(*added)
    others = keyed.where(~drawn).drop(*added).select("*", no_rank)
    return winners.unionByName(others)


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = (10, 100),
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    shortest: int = 1,
    longest: int = 1,
    seed: int = SEED,
) -> DataFrame:
    """A draw from ``docs(doc_id, text)`` in the likeness of ``target(text)``, one row per document.

    Returns doc_id, n_words, n_features, weight, score and rank. Null text has no features and
    weight 0. Other columns are ignored, whatever their names. Rows that repeat each count and
    can each be drawn. An empty target leaves the weights to the corpus alone.
    """
    features = land(hashed_features(docs, buckets, shortest, longest), "features")
    aim = hashed_features(target.select(F.lit(0).alias("doc_id"), "text"), buckets, shortest, longest)
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(aim, buckets))
    return draw(weigh(features, gains, seed), share, min_words)
