"""Queries that choose rows, tickers and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import selection as SEL
from tickloom.plans.registry import query
from tickloom.sources.tables import DAILY_BARS_SQL, daily_bars, table

BARS = f"WITH {DAILY_BARS_SQL}"


def _segmented(bars):
    return bars.withColumn("source_ticker", F.col("ticker")).withColumn("ticker", F.concat_ws(".", "ticker", F.year("bar_date") % 3))


@query(
    f"""{BARS}, s AS (SELECT ticker AS source_ticker, ticker || '.' || CAST(year(bar_date) % 3 AS VARCHAR) AS ticker, close FROM bars),
        c AS (SELECT source_ticker, ticker, count(close) AS k FROM s GROUP BY source_ticker, ticker),
        n AS (SELECT source_ticker, ticker, row_number() OVER (PARTITION BY source_ticker ORDER BY k DESC, ticker) AS i FROM c)
        SELECT source_ticker, ticker, close FROM s WHERE ticker IN (SELECT ticker FROM n WHERE i = 1)""",
    "close",
)
def best_segments(spark, sf_dir):
    """The segment of each source with most values."""
    return SEL.best_segments(_segmented(daily_bars(spark, sf_dir))).select("source_ticker", "ticker", "close")


@query(f"{BARS} SELECT ticker, count(*) AS n_bars FROM bars GROUP BY ticker ORDER BY n_bars DESC, ticker LIMIT 1")
def longest_ticker(spark, sf_dir):
    """The ticker with most bars (a top-1 report)."""
    return SEL.longest_ticker(daily_bars(spark, sf_dir))


@query(f"{BARS}, a AS (SELECT bar_date FROM bars WHERE ticker = (SELECT ticker FROM bars GROUP BY ticker ORDER BY count(*) DESC, ticker LIMIT 1)) SELECT ticker, count(*) AS n FROM bars WHERE bar_date IN (SELECT bar_date FROM a) GROUP BY ticker")
def anchored_counts(spark, sf_dir):
    """Bars left on the longest ticker's dates."""
    return SEL.anchored(daily_bars(spark, sf_dir)).groupBy("ticker").agg(F.count("*").alias("n"))


@query(f"{BARS} SELECT ticker, close FROM bars WHERE ticker IN (SELECT DISTINCT ticker FROM bars ORDER BY ticker LIMIT 10)", "close")
def first_tickers(spark, sf_dir):
    """Bars of the first ten tickers (the sampling operator's limit)."""
    return SEL.first_keys(daily_bars(spark, sf_dir), 10).select("ticker", "close")


@query("SELECT o_orderkey FROM orders QUALIFY (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 5 = 0")
def strided_orders(spark, sf_dir):
    """Every fifth order of a customer."""
    return SEL.strided(table(spark, sf_dir, "orders"), 5, "o_custkey", "o_orderkey").select("o_orderkey")


@query(f"{BARS}, i AS (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY bar_date) - 1 AS i FROM bars) SELECT ticker, min(i) FILTER (close > 1900) AS first_idx FROM i GROUP BY ticker")
def first_high_closes(spark, sf_dir):
    """The place of a ticker's first close above a level."""
    return SEL.first_where(daily_bars(spark, sf_dir), F.col("close") > 1900, "ticker", "bar_date")


@query(f"{BARS}, d AS (SELECT ticker, bar_date, row_number() OVER (PARTITION BY ticker ORDER BY bar_date) - 1 AS i FROM bars) SELECT ticker, i // 5 AS episode, CAST(min(bar_date) AS VARCHAR) AS first_date, CAST(max(bar_date) AS VARCHAR) AS last_date FROM d GROUP BY ALL")
def five_day_episodes(spark, sf_dir):
    """Episodes of five dates."""
    out = SEL.episode_bounds(daily_bars(spark, sf_dir), 5)
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_brand END, CASE WHEN p_partkey % 2 = 0 THEN p_type END, 'UNKNOWN') AS label FROM part")
def coalesced_details(spark, sf_dir):
    """A detail from the first source that has it."""
    p = table(spark, sf_dir, "part")
    first = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("label"))
    second = p.where(F.col("p_partkey") % 2 == 0).select("p_partkey", F.col("p_type").alias("label"))
    return SEL.coalesced("p_partkey", ["label"], first, second)


@query(f"{BARS} SELECT ticker, close FROM bars WHERE NOT ticker IN ('1', '2', '3', '4') OR ticker IN ('2', '4')", "close")
def pruned_regime(spark, sf_dir):
    """Bars without regime tickers, but for basket and benchmark."""
    return SEL.without_regime(daily_bars(spark, sf_dir), ["1", "2", "3", "4"], ["2"], "4").select("ticker", "close")
