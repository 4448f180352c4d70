"""Bounded ranking: top-k, fair allocation, diversity order, global order.

Every ranking filter carries a *literal* ceiling next to any per-request limit.
Catalyst then places a WindowGroupLimit before the shuffle, so a hot group sends
at most ``ceiling`` rows per map task, however many rows it holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import reliable_cut

Keys = Sequence[str | Column]


def top_k(
    df: DataFrame,
    keys: Keys,
    order: Keys,
    ceiling: int | None,
    limit: Column | None = None,
    rank: str = "rank",
) -> DataFrame:
    """First rows per key in ``order``; rank starts at 1. Without a ceiling all rows are ranked."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = F.col(rank) <= ceiling if ceiling is not None else F.lit(True)
    return ranked.filter(kept if limit is None else kept & (F.col(rank) <= limit))


def first_per(df: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    return top_k(df, keys, order, 1, rank="__first").drop("__first")


def round_robin(
    df: DataFrame,
    request: Keys,
    group: Keys,
    within: Keys,
    budget: Column,
    ceiling: int,
    rank: str = "rank",
) -> DataFrame:
    """Fair share of a budget: position 1 of every group, then position 2, …

    ``group`` is both the group identity and the order in which groups take turns.
    No group can win more than the budget, so positions past ``ceiling`` are dropped
    before the second ranking.
    """
    turn = "__turn"
    spaced = top_k(df, [*request, *group], within, ceiling, rank=turn)
    return top_k(spaced, request, [turn, *group], ceiling, budget, rank).drop(turn)


def diversify(
    df: DataFrame, request: Keys, identity: Keys, target: Keys, order: Keys, rank: str = "rank"
) -> DataFrame:
    """Drop repeated identities, then put the first row of every target before variants.

    Input must already be bounded per request (see ``round_robin``).
    """
    unique = first_per(df, [*request, *identity], order)
    repeat = F.row_number().over(Window.partitionBy(*request, *target).orderBy(*order)) > 1
    flagged = unique.withColumn("__repeat", repeat)
    over = Window.partitionBy(*request).orderBy("__repeat", *order)
    return flagged.withColumn(rank, F.row_number().over(over)).drop("__repeat")


def _globally_sorted(df: DataFrame, order: Keys) -> DataFrame:
    """Rows with the number of their range partition (``__part``) and their place in it.

    Checkpointed, so that every later use sees the very same partitions, also after a
    lost executor.
    """
    ranged = df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order])
    numbered = ranged.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return (
        reliable_cut(numbered)
        .withColumn("__part", F.shiftrightunsigned("__at", 33))
        .withColumn("__place", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__at")
    )


def _sum_before(part_totals: DataFrame, column: str) -> DataFrame:
    """Sum of ``column`` over earlier partitions; one row per partition of the sort."""
    earlier = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return part_totals.select(
        "__part", F.coalesce(F.sum(column).over(earlier), F.lit(0)).alias("__before")
    )


def global_index(df: DataFrame, order: Keys, index: str = "index") -> DataFrame:
    """0-based position in one total order, without ever sorting in one task."""
    rows = _globally_sorted(df, order)
    before = _sum_before(rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")), "__n")
    return (
        rows.join(before, "__part")
        .withColumn(index, (F.col("__before") + F.col("__place")).cast("bigint"))
        .drop("__part", "__before", "__place")
    )


def count_before(df: DataFrame, order: Keys, flag: str, name: str) -> DataFrame:
    """How many rows with ``flag`` = 1 precede each row in one total order.

    The inner window covers one range partition, which the sort keeps to an even share.
    """
    rows = _globally_sorted(df, order)
    before = _sum_before(rows.groupBy("__part").agg(F.sum(flag).alias("__n")), "__n")
    inside = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__inside", F.coalesce(F.sum(flag).over(inside), F.lit(0)))
        .join(before, "__part")
        .withColumn(name, (F.col("__before") + F.col("__inside")).cast("bigint"))
        .drop("__part", "__before", "__place", "__inside")
    )


def nearest_rank(df: DataFrame, key: str, value: str, quantiles: Sequence[float]) -> DataFrame:
    """Nearest-rank percentiles per key: the value at sorted position ceil(n·q).

    Rows are counted per (key, value) before anything is sorted, so neither a key nor a
    single value that most rows share is gathered anywhere; ranks are running counts.
    """
    tallies = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("__rows"))
    placed = count_before(tallies, [key, value], "__rows", "__from")
    bounds = placed.groupBy(key).agg(F.min("__from").alias("__start"), F.sum("__rows").alias("__n"))
    wanted = bounds.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    wanted = wanted.withColumn(
        "__index",
        F.col("__start")
        + F.greatest(F.lit(1), F.ceil(F.col("__n") * F.col("quantile"))).cast("bigint")
        - 1,
    ).withColumnRenamed(key, "__key")
    return placed.join(
        wanted,
        F.col(key).eqNullSafe(F.col("__key"))
        & (F.col("__from") <= F.col("__index"))
        & (F.col("__index") < F.col("__from") + F.col("__rows")),
    ).select(key, "quantile", F.col("__n").alias("n"), F.col(value).alias("value"))


def quantile_picks(df: DataFrame, key: str, order: str, count: int) -> DataFrame:
    """``count`` evenly spread rows per key at offsets floor((2i+1)·n / 2·count) in ``order``."""
    indexed = global_index(df, [key, order])
    sizes = indexed.groupBy(key).agg(
        F.min("index").alias("__start"), F.count(F.lit(1)).alias("__n")
    )
    offsets = (
        sizes.filter(F.col("__n") >= count)
        .withColumn("stratum", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        .withColumn(
            "index",
            F.col("__start")
            + F.floor((2 * F.col("stratum") + 1) * F.col("__n") / (2 * count)).cast("bigint"),
        )
        .select("index", "stratum")
    )
    return offsets.join(indexed, "index").drop("index")
