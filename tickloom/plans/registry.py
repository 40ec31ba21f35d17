"""Registration of queries: a function of (spark, sf_dir), its columns to round, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6
#: Date columns of queries, given as text on both sides: engines hand dates to clients in different types.
DATES = {
    "bar_date": (
        "daily_ohlcv", "rolling_statistics", "rolling_quantiles", "rolling_nearest_rank", "rolling_correlation", "cumulative_windows",
        "since_significant_move", "lifecycle_segments", "densified_bars", "split_adjusted_bars", "segment_split_adjusted_bars", "stitched_tickers", "long_histories", "discontinuities",
        "benchmark_ratio", "candle_features", "return_features", "volatility_features", "volume_features", "money_flow_index", "lag_pack",
        "rolling_z_scores", "rolling_z_features", "level_deltas", "cross_section_scores", "train_fitted_scaler", "market_breadth", "ratio_regime", "term_structure",
        "relative_strength", "sector_rotation", "stored_year", "regime_table", "trend_indicators", "classic_indicators", "paged_bars", "clustered_window",
    ),
    "execution_date": (
        "verified_splits",
    ),
    "change_date": (
        "suspect_renames",
    ),
    "last_valid": (
        "survivorship",
    ),
    "step": (
        "buy_and_hold_curve",
    ),
    "first_date last_date": (
        "protocol_segments", "basket_range",
    ),
    "train_start train_end valid_start valid_end": (
        "walk_forward_folds",
    ),
    "start_date end_date": (
        "episode_pool",
    ),
}


def rounded(x: Column, digits: int = DIGITS) -> Column:
    """floor(x 10^digits + 0.50013) / 10^digits in doubles, as the SQL has it: what has no digits after the point, infinity and NaN stay as they are (floor() gives a bigint)."""
    y = x.cast("double") * 10.0**digits + 0.50013
    return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y) / 10.0**digits


def query(sql: str | None = None, doubles: str = "", digits: int = DIGITS) -> Callable[[Query], Query]:
    """Registers a query under its function's name. doubles: columns rounded on both sides by the same float arithmetic, as sums depend on
    their order; the odd offset keeps decimal ties away from the cut."""
    columns = doubles.split()

    def register(f: Query) -> Query:
        dates = [c for names, queries in DATES.items() if f.__name__ in queries for c in names.split()]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            df = df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df
            return df.withColumns({c: rounded(F.col(c), digits) for c in columns}) if columns else df

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            put = [f"floor(CAST({c} AS DOUBLE) * {10**digits}.0 + 0.50013) / {10**digits}.0 AS {c}" for c in columns] + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates]
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(put)}) FROM (\n{sql}\n) t" if put else sql
        return run

    return register
