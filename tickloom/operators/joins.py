"""Joins by time and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_next(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], strict: bool = True) -> DataFrame:
    """Every left row with `values` of the first right row of its key after (or, not strict, at) its time; nulls if none.

    Both sides are put on one time line by a union, and the value travels backwards in one window over the key: one
    shuffle, linear work, no range join. Of right rows at one time the one with the least values counts.
    """
    rank = 1 if strict else 0
    lefts = left.select(*by, F.col(left_time).alias("__t"), F.lit(rank).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).alias("__r"))
    rights = right.groupBy(*by, F.col(right_time).alias("__t")).agg(F.min(F.struct(*values)).alias("__r")).select(*by, "__t", F.lit(1 - rank).alias("__side"), F.lit(None).alias("__l"), F.col("__r"))
    line = lefts.unionByName(rights)
    ahead = Window.partitionBy(*by).orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("__v", F.last("__r", ignorenulls=True).over(ahead)).where("__l is not null")
    return found.select("__l.*", *[F.col("__v")[v].alias(v) for v in values])


def within_days(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, days: int) -> DataFrame:
    """Pairs of a key whose dates are at most `days` apart, as an equi join on (key, block of days).

    Each right row is sent to the three blocks around its date, each left row to its own.
    """
    block = lambda c: F.floor(F.unix_date(F.col(c)) / (days or 1))
    reach = F.explode(F.sequence(block(right_date) - 1, block(right_date) + 1))
    near = F.abs(F.datediff(left_date, right_date)) <= days
    return left.withColumn("__b", block(left_date)).join(right.withColumn("__b", reach), [key, "__b"]).where(near).drop("__b")


def in_ranges(df: DataFrame, ranges: DataFrame, column: str, low: str, high: str, days: int = 32) -> DataFrame:
    """Rows with each date range (fold, window) that holds them, both ends included, as an equi join on blocks of `days` days.

    A range is sent to the blocks it touches, a row to its own. Ranges or rows with a null end or date match nothing.
    """
    block = lambda c: F.floor(F.unix_date(F.to_date(F.col(c))) / days)
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("__b", F.explode(F.sequence(block(low), block(high))))
    return df.withColumn("__b", block(column)).join(spread, "__b").where(F.col(column).between(F.col(low), F.col(high))).drop("__b")


def with_benchmark(df: DataFrame, benchmark: Column, time: str, values: list[str]) -> DataFrame:
    """Each row with the benchmark's values at its time. The benchmark is one row per time."""
    side = df.where(benchmark).select(time, *[F.col(v).alias(f"benchmark_{v}") for v in values])
    return df.join(side, time, "left")


def complete_keys(df: DataFrame, by: str, time: str) -> DataFrame:
    """Rows of the times at which every key has a row (an inner chain over keys, without the chain)."""
    n = df.select(by).distinct().count()
    whole = df.groupBy(time).agg(F.countDistinct(by).alias("__n")).where(F.col("__n") == n).select(time)
    return df.join(whole, time, "left_semi")
