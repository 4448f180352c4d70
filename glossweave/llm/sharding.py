"""Shards of near-equal bytes by histogram sort, in DataFrame functions only.

Rows are ordered by key and place. Splitters are found by counting: each round takes probe
keys inside the interval that still holds each splitter and counts the exact bytes below
every probe over all partitions; the interval shrinks until the bytes below a splitter are
within tolerance or a single key is left. A key that many rows share is split further by
the rows' places. Shards are cut into parts by further splitters, found alike with a wider
tolerance. Then one exchange sends each row to the part that the splitters name, and slots
are running counts of the sorted parts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import land

SHARDS = 8
TOLERANCE = 0.001
PROBES = 64
#: Share of a part's bytes by which a part within a shard may miss its goal, and probes for each.
PART_TOLERANCE = 0.2
PART_PROBES = 8
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, UTF-8 bytes of the text plus 1, CRC-32 of the text (null: none, as empty) and a place."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )


def _longs(values: list[int]) -> Column:
    """A literal array that stays one literal in the plan, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _below(count: int, reached: Callable[[Column], Column]) -> Column:
    """How many of ``count`` sorted points are reached, by bisection; ``reached`` tells of the point at a place."""
    steps = F.sequence(F.lit(1), F.lit(max(1, count.bit_length())))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        return F.when(s["low"] >= s["high"], s).otherwise(
            F.when(reached(middle), F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(
                F.struct(s["low"].alias("low"), middle.alias("high"))
            )
        )

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(count).alias("high")), halve)["low"]


def _refine(rows: DataFrame, targets: list[float], tolerance: float, probes: int) -> list[tuple[int, float]]:
    """For each target, a boundary on ``at`` and the exact ``size`` of the rows below it.

    The boundary is within ``tolerance`` of its target, or the rows of the largest value
    below the target come next: then no boundary of ``at`` alone can be closer from below.
    """
    ends = rows.agg(F.min("at").alias("a"), F.max("at").alias("b"), F.sum("size").alias("s")).first()
    if ends["a"] is None:
        return [(_LEAST, 0.0) for _ in targets]
    spans = [(ends["a"], 0, ends["b"] + 1, ends["s"]) for _ in targets]  # bytes below both ends
    while True:
        asked: set[int] = set()
        for target, (a, below_a, b, below_b) in zip(targets, spans, strict=True):
            if b - a > 1 and target - below_a > tolerance and below_b - target > tolerance:
                step = max(1, (b - a) // (probes + 1))
                asked |= set(range(a + step, b, step)[: probes + 1])
                guess = a + int((b - a) * ((target - below_a) / max(1, below_b - below_a)))
                asked |= {min(max(guess + d, a + 1), b - 1) for d in (-step // 8, 0, step // 8)}
        if not asked:
            break
        points = sorted(asked)
        listed = _longs(points)
        at = _below(len(points), lambda k: F.get(listed, k) <= F.col("at"))
        tally = {
            r["k"]: r["s"]
            for r in rows.select(at.alias("k"), "size").groupBy("k").agg(F.sum("size").alias("s")).collect()
        }
        below, total = [], 0
        for k in range(len(points)):
            total += tally.get(k, 0)
            below.append(total)
        for n, target in enumerate(targets):
            a, below_a, b, below_b = spans[n]
            first, last = bisect_right(points, a), bisect_left(points, b)
            over = min(max(bisect_right(below, target), first), last)  # bytes below points never fall
            if over > first:
                a, below_a = points[over - 1], below[over - 1]
            if over < last:
                b, below_b = points[over], below[over]
            spans[n] = (a, below_a, b, below_b)
    return [
        (b, below_b) if below_b - target <= tolerance and below_b - target < target - below_a else (a, below_a)
        for target, (a, below_a, b, below_b) in zip(targets, spans, strict=True)
    ]


def _boundaries(rows: DataFrame, goals: list[float], slack: float, probes: int) -> list[tuple[int, int]]:
    """(key, place) for each goal of bytes below it; the goals that one key's rows cross are found together."""
    found, crossed = [], {}
    for n, (key, below) in enumerate(_refine(rows.withColumn("at", F.col("key")), goals, slack, probes)):
        found.append((key, _LEAST))
        if goals[n] - below > slack:
            crossed.setdefault(key, []).append((n, goals[n] - below))
    for key, wanted in crossed.items():  # each of these keys holds more than ``slack`` bytes
        inside = rows.where(F.col("key") == key).withColumn("at", F.col("place"))
        for (n, _), (place, _) in zip(wanted, _refine(inside, [w for _, w in wanted], slack, probes), strict=True):
            found[n] = (key, place)
    return found


def find_splitters(
    rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, probes: int = PROBES
) -> list[tuple[int, int]]:
    """``shards - 1`` boundaries (key, place): a row belongs above those that its own pair reaches.

    ``rows`` has key, place and size. Every round collects one row per probe, a number that
    depends on ``shards`` and ``probes`` only. ``tolerance`` is a share of a shard's size.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    goals = [total * (k + 1) / shards for k in range(shards - 1)]
    return _boundaries(rows, goals, tolerance * total / shards, probes)


def shard_rows(rows: DataFrame, boundaries: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with shard and slot; ``rows`` has key, place and size, and key and place name a row.

    Each shard is cut into as many parts as make up the session's shuffle partitions. One
    exchange sends each row to its part, where rows are sorted by key and place. A row's slot
    is its place in its sorted partition plus the rows of its shard in earlier partitions,
    counted once per partition.
    """
    shards = len(boundaries) + 1
    per_shard = -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    cuts = set(boundaries)
    if per_shard > 1:
        parts = shards * per_shard
        cuts |= set(find_splitters(rows, parts, PART_TOLERANCE, PART_PROBES))
    points = sorted(cuts)
    keys, places = _longs([key for key, _ in points]), _longs([place for _, place in points])
    part = _below(
        len(points),
        lambda k: (F.get(keys, k) < F.col("key")) | ((F.get(keys, k) == F.col("key")) & (F.get(places, k) <= F.col("place"))),
    )
    shard = sum(
        (
            ((F.col("key") > key) | ((F.col("key") == key) & (F.col("place") >= place))).cast("int")
            for key, place in boundaries
        ),
        F.lit(0),
    )
    exchanged = (
        rows.withColumn("shard", shard)
        .repartitionById(len(points) + 1, part.cast("int"))
        .sortWithinPartitions("key", "place")
        .withColumn("row", F.monotonically_increasing_id())
    )
    fixed = land(exchanged, "shards")
    part = F.shiftright("row", 33)
    tally = fixed.groupBy(part.alias("part"), "shard").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    return fixed.withColumn("part", part).join(tally.select("part", "shard", "base"), ["part", "shard"]).select(
        *[c for c in rows.columns], "shard", (F.col("row") + F.col("base")).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs(doc_id, text)``.

    Shards are ranges of doc_id of near-equal bytes: each boundary is within ``tolerance`` of
    a shard's share, or within one row of it. Null text has size 1. Rows with a null doc_id
    come first; rows that share a doc_id are kept apart by their place, so a hot key is split
    where needed. Other columns are ignored; an empty table gives no rows.
    """
    rows = land(sized_rows(docs).withColumn("key", F.coalesce("doc_id", F.lit(_LEAST + 1))), "sizes")
    return shard_rows(rows, find_splitters(rows, shards, tolerance)).drop("key", "place")
