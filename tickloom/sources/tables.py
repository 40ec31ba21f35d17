"""Bars made of the star-schema tables: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of lineitem: ticker is the supplier, price the price of a unit, volume the quantity."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("bar_date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity",
    )
    return rows.groupBy("ticker", "bar_date").agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("l_quantity").alias("volume"), F.count("*").alias("transactions")
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticker of every trade that daily_bars() are made of: no ticker has more bars, and counting these needs no bars."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("ticker"))


DAILY_BARS_SQL = """bars AS (
  SELECT ticker, bar_date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(q) AS volume, count(*) AS transactions
  FROM (SELECT cast(l_suppkey AS varchar) AS ticker, cast(l_shipdate AS date) AS bar_date, l_extendedprice / l_quantity AS p,
               l_orderkey * 10 + l_linenumber AS k, l_quantity AS q FROM lineitem) GROUP BY ticker, bar_date)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: ticker is the event type, price the value."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"), "user_id", "props")


TICKS_SQL = "ticks AS (SELECT event_type AS ticker, ts, event_id AS id, value AS price, user_id, props FROM events)"


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.operators.rollup import rollup

    return rollup(ticks(spark, sf_dir), "1 hour")


HOURLY_BARS_SQL = (
    TICKS_SQL
    + """, bars AS (
  SELECT ticker, date_trunc('hour', ts) AS bucket, arg_min(price, ts + to_microseconds(id)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, ts + to_microseconds(id)) AS close, count(*) AS volume FROM ticks GROUP BY ALL)"""
)
