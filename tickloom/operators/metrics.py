"""Performance of equity curves, per group. A curve is rows (curve, step, pv)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.windows import drawdown, ordered, trailing

YEAR = 252
RISK_FREE = 0.02 / YEAR


def curve_returns(curves: DataFrame) -> DataFrame:
    w = ordered("curve", "step")
    before = F.lag("pv").over(w)
    return curves.withColumns({"r": F.try_divide("pv", before) - 1, "pnl": F.col("pv") - before, "dd": drawdown(F.col("pv"), w)})


def performance(curves: DataFrame, rf: float = RISK_FREE, year: int = YEAR) -> DataFrame:
    """curve, total_return, annual_return, sharpe, sortino, max_drawdown, calmar, profit_factor; null where undefined."""
    r, x, root = curve_returns(curves), F.col("r") - rf, math.sqrt(year)
    by = r.groupBy("curve").agg(
        F.min_by("pv", "step").alias("first"), F.max_by("pv", "step").alias("last"), (F.count("*") - 1).alias("n"),
        F.avg(x).alias("excess"), F.stddev_samp("r").alias("sd"), F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2)))).alias("down"),
        F.max("dd").alias("max_drawdown"), F.sum(F.greatest("pnl", F.lit(0.0))).alias("gain"), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0))).alias("loss"),
    )
    annual = F.pow(F.try_divide("last", "first"), F.try_divide(F.lit(float(year)), "n")) - 1
    return by.select(
        "curve", (F.try_divide("last", "first") - 1).alias("total_return"), annual.alias("annual_return"), (F.try_divide("excess", "sd") * root).alias("sharpe"),
        (F.try_divide("excess", "down") * root).alias("sortino"), "max_drawdown", F.try_divide(annual, "max_drawdown").alias("calmar"), F.try_divide("gain", "loss").alias("profit_factor"),
    )


def buy_and_hold(prices: DataFrame, cash: float = 100_000.0) -> DataFrame:
    """curve 'hold', step (bar_date), pv of equal amounts put into every ticker on its first date. prices: ticker, bar_date, close."""
    first = prices.groupBy("ticker").agg(F.min_by("close", "bar_date").alias("p0"))
    n = prices.select("ticker").distinct().count()
    held = prices.join(first, "ticker").groupBy("bar_date").agg((F.sum(F.col("close") / F.col("p0")) * (cash / n)).alias("pv"))
    return held.select(F.lit("hold").alias("curve"), F.col("bar_date").alias("step"), "pv")


def compounded(segments: DataFrame, start: float = 100_000.0) -> DataFrame:
    """One curve from segments that each began anew: (segment, step, pv) with every segment scaled to the end of the one before."""
    ends = segments.groupBy("segment").agg(F.min_by("pv", "step").alias("a"), F.max_by("pv", "step").alias("b"))
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    scale = ends.select("segment", "a", F.coalesce(F.product(F.col("b") / F.col("a")).over(before), F.lit(1.0)).alias("grown"))
    return segments.join(F.broadcast(scale), "segment").select("segment", "step", (F.col("pv") / F.col("a") * F.col("grown") * start).alias("pv"))


def protocol_segments(dates: DataFrame, length: int = YEAR) -> DataFrame:
    """segment, first and last date of stretches of `length` steps that share their boundary date. dates: one row per date."""
    at = dates.withColumn("i", F.row_number().over(Window.orderBy("bar_date")) - 1)
    first = at.select("bar_date", F.floor(F.col("i") / length).alias("segment"))
    both = first.unionByName(at.where((F.col("i") > 0) & (F.col("i") % length == 0)).select("bar_date", (F.floor(F.col("i") / length) - 1).alias("segment")))
    return both.groupBy("segment").agg(F.min("bar_date").alias("first_date"), F.max("bar_date").alias("last_date"), F.count("*").alias("n_steps")).where("n_steps > 1")


def test_window(dates: DataFrame, last_year: int, years: int) -> DataFrame:
    """Dates of the last `years` calendar years up to last_year."""
    return dates.where(F.year("bar_date").between(last_year - years + 1, last_year))


def valid_range(prices: DataFrame, n_tickers: int) -> DataFrame:
    """first_date and last_date at which every ticker has a finite close, and dates between them that lack one."""
    by = prices.groupBy("bar_date").agg(F.count_if(F.col("close").isNotNull() & ~F.isnan("close")).alias("n"))
    whole = F.when(F.col("n") == n_tickers, F.col("bar_date"))
    edges = by.agg(F.min(whole).alias("first_date"), F.max(whole).alias("last_date"))
    one = F.lit(1).alias("__one")
    inside = by.select("*", one).join(F.broadcast(edges.select("*", one)), "__one").where(F.col("bar_date").between(F.col("first_date"), F.col("last_date")))  # edges: one row
    return inside.groupBy("first_date", "last_date").agg(F.count_if(F.col("n") < n_tickers).alias("n_gaps"))


def episode_summary(episodes: DataFrame, by: list[str], per_year: float = YEAR / 5) -> DataFrame:
    """Mean, median, deviation, extremes, share positive, growth and its logarithm (of the product itself) of episode returns. episodes: by, episode, ret, benchmark."""
    r = F.col("ret")
    return episodes.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(r).alias("mean"), F.median(r).alias("median"), F.stddev_pop(r).alias("std"), F.min(r).alias("worst"), F.max(r).alias("best"),
        F.avg((r > 0).cast("double")).alias("positive"), F.avg((r > F.col("benchmark")).cast("double")).alias("beat_benchmark"), (F.product(1 + r) - 1).alias("cumulative"), F.ln(F.product(1 + r)).alias("log_growth"),
        (F.try_divide(F.avg(r), F.stddev_samp(r)) * math.sqrt(per_year)).alias("sharpe"),
    )


def weight_statistics(weights: DataFrame, by: list[str], cash: str = "cash") -> DataFrame:
    """by, asset, mean, std (population), least, most of each asset's weight over the steps of an episode, cash being what the others leave.

    weights: by, step, asset, weight. Weights of one asset in one step add up; an asset that a step does not name has weight 0 there.
    Sums merge before the shuffle, and what joins them is one row an episode.
    """
    held = weights.groupBy(*by, "step", "asset").agg(F.sum("weight").alias("weight"))
    rest = held.groupBy(*by, "step").agg(F.lit(cash).alias("asset"), (1 - F.sum("weight")).alias("weight"))
    steps = rest.groupBy(*by).agg(F.count("*").alias("__steps"))
    found = held.unionByName(rest).groupBy(*by, "asset").agg(
        F.count("*").alias("__n"), F.avg("weight").alias("__mean"), F.var_pop("weight").alias("__var"), F.min("weight").alias("__min"), F.max("weight").alias("__max")
    )
    share = F.col("__n") / F.col("__steps")
    # The steps without the asset are a second group, of mean and deviation 0.
    var = share * (F.col("__var") + F.pow("__mean", F.lit(2)) * (1 - share))
    filled = lambda pick, c: F.when(F.col("__n") < F.col("__steps"), pick(F.col(c), F.lit(0.0))).otherwise(F.col(c))
    return found.join(steps, by).select(*by, "asset", (F.col("__mean") * share).alias("mean"), F.sqrt(var).alias("std"), filled(F.least, "__min").alias("least"), filled(F.greatest, "__max").alias("most"))


def best_checkpoint(calls: DataFrame) -> DataFrame:
    """The call with the highest score of each fold, the earliest of equals. calls: fold, call, score."""
    return calls.groupBy("fold").agg(F.max_by("call", F.struct("score", -F.col("call"))).alias("call"), F.max("score").alias("score"))


def smoothed(rows: DataFrame, by: str, order: str, value: str, n: int = 10) -> DataFrame:
    """Moving average of a metric, from the n-th row on."""
    w = ordered(by, order)
    return rows.withColumn("ma", F.when(F.row_number().over(w) >= n, F.avg(value).over(trailing(w, n))))
