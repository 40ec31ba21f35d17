"""Flows: operators put together from bars to a table that models read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import features as FT
from tickloom.operators import lifecycle as L
from tickloom.operators import normalize as N


def daily_flow(
    bars: DataFrame, normalised: list[str], across: list[str], calendar: DataFrame | None = None, splits: DataFrame | None = None, regime: DataFrame | None = None,
    least_rows: int = L.MIN_ROWS, jump: float = L.JUMP, n: int = 252, counted: DataFrame | None = None,
) -> DataFrame:
    """Daily bars to features: lifetimes cut at gaps, prices adjusted (with splits, each within its lifetime), sessions filled (with a calendar), tickers
    with a short or broken history left out, features of daily_features(), rolling z-scores, cross-section scores, and the
    market-wide columns of each date (with a regime table). counted: as in scan.split().

    Two shuffles of the bars, by ticker and by date; every per-ticker step shares the first one's order.
    """
    if calendar is not None:
        cut = L.segments(bars, calendar)
        cut = cut if splits is None else L.segment_split_adjusted(cut, splits)
        bars = L.densified(cut.select(bars.columns), calendar)
    elif splits is not None:
        bars = L.split_adjusted(bars, splits)
    good = L.ticker_status(bars, least_rows, jump).where("status = 'ok'").select("ticker")
    kept = bars.join(good, "ticker", "left_semi")
    rows = FT.daily_features(kept, counted=counted)
    rows = N.cross_section(N.rolling_normalised(rows, normalised, n=n, counted=bars if counted is None else counted), across)
    return rows if regime is None else rows.join(regime, "bar_date", "left")


def unified_columns(rows: DataFrame, keys: tuple[str, ...] = ("ticker", "bar_date"), kind: str = "float") -> DataFrame:
    """The flow's table with all numbers in a smaller type."""
    return rows.select(*[F.col(c) if c in keys or t not in ("double", "bigint", "int") else F.col(c).cast(kind).alias(c) for c, t in rows.dtypes])
