"""OHLCV rollups into time buckets, in batch. The streaming form is in tickloom.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERVALS = ("5 minutes", "15 minutes", "30 minutes", "1 hour", "1 day")


def ohlcv(price: str = "price", order: tuple[str, ...] = ("ts", "id")) -> list[Column]:
    """First, highest, lowest, last price and the number of ticks; all merge map-side."""
    at = F.struct(*order)
    return [
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume"),
    ]


def rollup(ticks: DataFrame, interval: str, time: str = "ts", by: str = "ticker") -> DataFrame:
    """One bar per (ticker, bucket) of ticks."""
    return ticks.groupBy(by, F.window(time, interval).alias("w")).agg(*ohlcv(order=(time, "id"))).select(by, F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume")


def coarser(bars: DataFrame, interval: str) -> DataFrame:
    """Bars of bars: a rollup on top of a rollup."""
    return bars.groupBy("ticker", F.window("bucket", interval).alias("w")).agg(
        F.min_by("open", "bucket").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bucket").alias("close"), F.sum("volume").alias("volume")
    ).select("ticker", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume")


def live_view(materialised: DataFrame, ticks: DataFrame, interval: str, watermark) -> DataFrame:
    """Stored buckets before the watermark, fresh ones from raw ticks at and after it."""
    return materialised.where(F.col("bucket") < watermark).unionByName(rollup(ticks.where(F.col("ts") >= watermark), interval))
