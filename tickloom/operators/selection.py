"""Choosing rows, tickers and episodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.windows import ordered


def best_segments(rows: DataFrame, source: str = "source_ticker", segment: str = "ticker", value: str = "close") -> DataFrame:
    """Rows of the segment of each source that has most values; of equals the first by name."""
    counts = rows.groupBy(source, segment).agg(F.count(value).alias("__n"))
    best = counts.withColumn("__i", F.row_number().over(Window.partitionBy(source).orderBy(F.desc("__n"), segment))).where("__i = 1").select(source, segment)
    return rows.join(best, [source, segment], "left_semi")


def longest_ticker(rows: DataFrame, by: str = "ticker") -> DataFrame:
    """The ticker with most rows; of equals the first by name. Its dates can anchor a common time line."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n_bars"))
    return counts.orderBy(F.desc("n_bars"), by).limit(1)


def anchored(rows: DataFrame, by: str = "ticker", time: str = "bar_date") -> DataFrame:
    """Rows at the times of the longest ticker; times it lacks vanish."""
    anchor = rows.join(longest_ticker(rows, by).select(by), by, "left_semi").select(time)
    return rows.join(anchor, time, "left_semi")


def first_keys(rows: DataFrame, k: int, by: str = "ticker") -> DataFrame:
    """Rows of the first k keys by name (a sampling operator's own limit)."""
    keys = rows.select(by).distinct().orderBy(by).limit(k)
    return rows.join(F.broadcast(keys), by, "left_semi")


def strided(rows: DataFrame, step: int, by: str, *order: str) -> DataFrame:
    """Every step-th row of each key, the first one included."""
    return rows.withColumn("__i", F.row_number().over(ordered(by, *order)) - 1).where(F.col("__i") % step == 0).drop("__i")


def indexed(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """idx from 0 within each key."""
    return rows.withColumn("idx", (F.row_number().over(ordered(by, *order)) - 1).cast("bigint"))


def first_where(rows: DataFrame, condition: Column, by: str, order: str) -> DataFrame:
    """The place, from 0, of each key's first row that the condition holds for; null if none."""
    at = rows.withColumn("__i", F.row_number().over(ordered(by, order)) - 1)
    return at.groupBy(by).agg(F.min(F.when(condition, F.col("__i"))).cast("bigint").alias("first_idx"))


def episode_bounds(rows: DataFrame, days: int, by: str = "ticker", date: str = "bar_date") -> DataFrame:
    """episode, first and last date of stretches of `days` dates of each key."""
    dates = rows.select(by, date).distinct().withColumn("__i", F.row_number().over(ordered(by, date)) - 1)
    return dates.groupBy(by, F.floor(F.col("__i") / days).alias("episode")).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def without_regime(rows: DataFrame, regime: list[str], basket: list[str], benchmark: str) -> DataFrame:
    """Rows without regime tickers, but for the basket and the benchmark."""
    return rows.where(~F.col("ticker").isin(regime) | F.col("ticker").isin([*basket, benchmark]))


def coalesced(key: str, columns: list[str], *sources: DataFrame) -> DataFrame:
    """One row per key of the first source, each column from the first source that has a value; UNKNOWN for text none has."""
    named = [s.select(key, *[F.col(c).alias(f"{c}__{i}") for c in columns]) for i, s in enumerate(sources)]
    joined = reduce(lambda a, b: a.join(b, key, "left"), named)
    kinds = dict(sources[0].dtypes)
    fill = lambda c: [F.lit("UNKNOWN")] if kinds[c] == "string" else []
    return joined.select(key, *[F.coalesce(*[F.col(f"{c}__{i}") for i in range(len(sources))], *fill(c)).alias(c) for c in columns])
