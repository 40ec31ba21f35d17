"""Read-only checks of a feature table. Each gives tidy rows; audit_scan.audit() makes all of them in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import gram


def long_form(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, feature, value."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "feature", "value")


def missing_and_invalid(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n_null, n_nan, n_inf in one pass."""
    return long_form(df, [], columns).groupBy("feature").agg(
        F.count_if(F.col("value").isNull()).alias("n_null"), F.count_if(F.isnan("value")).alias("n_nan"), F.count_if(F.abs("value") == float("inf")).alias("n_inf")
    )


def statistics(df: DataFrame, columns: list[str], saturated: float = 0.99) -> DataFrame:
    """feature, mean, variance (sample), skew (biased moments), share of values beyond +-saturated."""
    return long_form(df, [], columns).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.skewness("value").alias("skew"), F.avg((F.abs("value") > saturated).cast("double")).alias("saturation")
    )


def yearly_drift(df: DataFrame, columns: list[str], date: str = "bar_date", limit: float = 0.5, least: int = 10) -> DataFrame:
    """feature, year and shift of mean (in deviations of the year before) and deviation between adjacent years; flagged beyond limit."""
    by = long_form(df.withColumn("year", F.year(date)), ["year"], columns).groupBy("feature", "year").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy("feature").orderBy("year")
    prior = by.withColumns({x: F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag(y).over(w)) for x, y in (("pm", "m"), ("ps", "s"))})
    out = prior.where("pm is not null").select("feature", "year", F.try_divide(F.abs(F.col("m") - F.col("pm")), "ps").alias("mean_shift"), F.try_divide(F.abs(F.col("s") - F.col("ps")), "ps").alias("std_shift"))
    return out.withColumn("drifted", F.coalesce((F.col("mean_shift") > limit) | (F.col("std_shift") > limit), F.lit(False)))


def split_drift(df: DataFrame, columns: list[str], split: str, base: str = "train") -> DataFrame:
    """feature, split, shift of the mean against the base split in its deviations."""
    by = long_form(df, [split], columns).groupBy("feature", split).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    b = by.where(F.col(split) == base).select("feature", F.col("m").alias("bm"), F.col("s").alias("bs"))
    return by.where(F.col(split) != base).join(b, "feature").select("feature", split, F.try_divide(F.col("m") - F.col("bm"), "bs").alias("mean_shift"))


def correlations(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """a, b, r of every pair of columns (a < b), per group of by, from blocked products (gram)."""
    return gram.correlations(df, columns, by).select(*(by or []), "a", "b", "r")


def multicollinear(df: DataFrame, columns: list[str], limit: float = 0.95) -> DataFrame:
    """a, b, in how many tickers |r| reaches the limit, and its mean."""
    r = correlations(df, columns, ["ticker"])
    return r.groupBy("a", "b").agg(F.count_if(F.abs("r") >= limit).alias("n_high"), F.avg(F.abs("r")).alias("mean_abs_r"))


def survivorship(bars: DataFrame, days: int = 30) -> DataFrame:
    """last valid date of each ticker and whether it is active: within `days` of the last date of all."""
    last = bars.groupBy("ticker").agg(F.max(F.when(F.col("close") > 0, F.col("bar_date"))).alias("last_valid"))
    one = F.lit(1).alias("__one")
    end = last.agg(F.max("last_valid").alias("__end")).select("*", one)  # one row
    return last.select("*", one).join(F.broadcast(end), "__one").select("ticker", "last_valid", (F.datediff("__end", "last_valid") <= days).alias("active"))


def close_nulls(rows: DataFrame, by: str = "ticker", time: str = "bar_date", value: str = "close") -> DataFrame:
    """Nulls of each ticker before its first value, after its last, and between."""
    at = rows.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(time)))
    seen = F.when(F.col(value).isNotNull(), F.col("i"))
    g = at.groupBy(by).agg(F.count("*").alias("n"), F.min(seen).alias("lo"), F.max(seen).alias("hi"), F.count_if(F.col(value).isNull()).alias("n_null"))
    lead, trail = F.coalesce(F.col("lo") - 1, F.col("n")), F.coalesce(F.col("n") - F.col("hi"), F.lit(0))
    return g.select(by, lead.cast("bigint").alias("leading"), trail.cast("bigint").alias("trailing"), (F.col("n_null") - lead - trail).cast("bigint").alias("interior"))


def downcastable(df: DataFrame, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """feature, largest loss when stored as float, and whether that is within tolerance."""
    rows = long_form(df, [], columns).groupBy("feature").agg(F.max(F.abs(F.col("value") - F.col("value").cast("float").cast("double"))).alias("loss"))
    return rows.withColumn("fits", F.coalesce(F.col("loss") <= tolerance, F.lit(True)))


def downcast(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in columns})
