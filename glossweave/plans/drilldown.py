"""Comparing two whole tables by digests of ranges, from coarse to fine.

Rows are dealt to ranges by a hash of their key. A range's digest is how many rows it holds
and an exact sum of their hashes, added up in every task before anything moves, so equal
tables move one level of digests and nothing else. Where digests differ, the range is cut
into finer ones and only its rows are digested anew; in the end only the rows of the finest
ranges that differ are set side by side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import framed_row, hash60
from ..session import written

#: Binary digits by which a level's ranges are finer than those of the level above.
STEP = 6
#: Levels at most; their ranges together are told apart by STEP times as many digits.
LEVELS = 5
#: Ranges of a level that may differ and still be cut finer; with more the tables differ all over.
MOST_RANGES = 4096


@dataclass
class Comparison:
    """Rows that differ, and per level how many digests were compared and how many of them differed."""

    differences: DataFrame
    levels: list[tuple[int, int]] = field(default_factory=list)


def _hashed(table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The table with the hash of its key (60 bits) and of the whole row."""
    return table.select(*columns, hash60(framed_row(*keys)).alias("__key"), hash60(framed_row(*columns)).alias("__row"))


def _range(level: int) -> Column:
    return F.shiftright("__key", 60 - STEP * level)


def _digests(rows: DataFrame, level: int) -> DataFrame:
    return rows.groupBy(_range(level).alias("__range")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__row").cast("decimal(28,0)")).alias("sum")
    )


def compare_tables(
    left: DataFrame, right: DataFrame, keys: Sequence[str], levels: int = LEVELS, rows_enough: int = 100_000
) -> Comparison:
    """How ``right`` differs from ``left``, which have the same columns, by ``keys``.

    Differences are (keys, state, times_left, times_right) per distinct row that one side
    holds more often than the other: ``added`` or ``removed`` if the other side does not have
    the key, else ``changed``. NULL equals NULL, in keys too; rows that repeat are counted.
    Ranges are cut finer until they hold ``rows_enough`` rows or fewer together, ``levels``
    are reached or ``MOST_RANGES`` of a level differ.
    """
    columns = list(left.columns)
    if set(columns) != set(right.columns):
        raise ValueError("the tables have different columns")
    sides = [_hashed(t.select(*columns), keys, columns) for t in (left, right)]
    told: list[tuple[int, int]] = []
    for level in range(1, levels + 1):
        one, two = (_digests(side, level).toDF("__range", f"n{k}", f"sum{k}") for k, side in enumerate(sides))
        # at most 2 to the power of STEP times the level rows, and as many as ranges that still differ allow
        joined = one.join(two, "__range", "full_outer").withColumn(
            "__differs", ~(F.col("n0").eqNullSafe(F.col("n1")) & F.col("sum0").eqNullSafe(F.col("sum1")))
        )
        joined = written(joined, "digests")
        compared, differ, rows = joined.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.col("__differs").cast("int")), F.lit(0)),
            F.coalesce(F.sum(F.when(F.col("__differs"), F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0)))), F.lit(0)),
        ).first()
        told.append((compared, differ))
        ranges = joined.where("__differs").select("__range")
        sides = [side.withColumn("__range", _range(level)).join(ranges, "__range", "left_semi").drop("__range") for side in sides]
        if not differ or rows <= rows_enough or differ > MOST_RANGES:
            break
    counted = [
        side.groupBy("__key", "__row").agg(F.count(F.lit(1)).alias("times"), *[F.first(k).alias(k) for k in keys]) for side in sides
    ]
    tagged = counted[0].withColumn("__side", F.lit(0)).unionByName(counted[1].withColumn("__side", F.lit(1)))
    times = [F.coalesce(F.sum(F.when(F.col("__side") == k, F.col("times"))), F.lit(0)) for k in (0, 1)]
    rows = tagged.groupBy("__key", "__row").agg(
        *[F.first(k).alias(k) for k in keys], times[0].alias("times_left"), times[1].alias("times_right")
    )
    sums = rows.groupBy("__key").agg(F.sum("times_left").alias("__left"), F.sum("times_right").alias("__right"))
    state = F.when(F.col("__left") == 0, "added").when(F.col("__right") == 0, "removed").otherwise("changed")
    differences = rows.where("times_left <> times_right").join(sums, "__key").select(
        *keys, state.alias("state"), "times_left", "times_right"
    )
    return Comparison(differences, told)
