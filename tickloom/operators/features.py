"""Features per ticker that windows express. Recursive averages are in indicators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickloom.functions.scalars import EPS, clipped, daily_phases, log_ratio
from tickloom.operators.scan import CHUNK, by_series
from tickloom.operators.sliding import counts, moments
from tickloom.operators.windows import ordered, rolling, rolling_corr


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def session_vwap(bars: DataFrame, day: str, time: str) -> DataFrame:
    """Running volume-weighted price of a session; the typical price before any volume."""
    w = ordered(["ticker", day], time).rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("vwap", F.coalesce(F.try_divide(F.sum(typical() * F.col("volume")).over(w), F.sum("volume").over(w)), typical()))


def candles(w: WindowSpec) -> dict[str, Column]:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = F.greatest(h - lo, F.lit(EPS))
    return {
        "vwap": typical(),
        "overnight_gap": F.coalesce(F.ln(F.try_divide(o, F.lag(c).over(w) + EPS)), F.lit(0.0)),
        "intraday_return": F.ln(F.try_divide(c * 1.0, o + EPS)),
        "upper_wick_ratio": (h - F.greatest(o, c)) / span,
        "lower_wick_ratio": (F.least(o, c) - lo) / span,
    }


def returns(w: WindowSpec, spans: tuple[int, ...] = (5, 20, 60, 120, 252)) -> dict[str, Column]:
    return {f"log_return_{n}": F.ln(F.try_divide(F.col("close"), F.lag("close", n).over(w))) for n in spans}


def with_volatility(
    df: DataFrame, by: str = "ticker", time: str = "bar_date", pairs: tuple[tuple[int, int], ...] = ((5, 20), (20, 60), (60, 252)), alone: int = 15, chunk: int = CHUNK, counted: DataFrame | None = None,
) -> DataFrame:
    """Log ratios of population deviations of the close, and ln(1 + deviation) over `alone` rows.

    Windows are put together from blocks (sliding.moments), so a row costs the logarithm of its spans. counted: as in scan.split().
    """
    spans = sorted({alone, *(n for pair in pairs for n in pair)})

    def kernel(table: pa.Table, place: np.ndarray) -> pa.Table:
        close = table.column("close")
        x, known = close.cast(pa.float64()).to_numpy(zero_copy_only=False), close.is_valid().to_numpy()
        for n in spans:
            with np.errstate(invalid="ignore"):
                sd = np.sqrt(moments(x, n)[1] / n)
            table = table.append_column(f"__s{n}", pa.array(sd, pa.float64(), mask=(place < n - 1) | (counts(known, n) < n)))
        return table

    schema = StructType([*df.schema.fields, *[StructField(f"__s{n}", DoubleType()) for n in spans]])
    made = by_series(df, [by], [time], kernel, schema, spans[-1] - 1, chunk, counted)
    sd = lambda n: F.col(f"__s{n}")
    out = made.withColumns({f"volatility_{a}_{b}_ratio": log_ratio(sd(a), sd(b)) for a, b in pairs} | {f"volatility_{alone}": F.log1p(sd(alone))})
    return out.drop(*(f"__s{n}" for n in spans))


def momentum(w: WindowSpec) -> dict[str, Column]:
    change = lambda n: F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1
    return {"roc_10": clipped(100 * change(10), -3.0, 3.0), "cum_return_15": change(15)}


def volume(w: WindowSpec, n: int = 20) -> dict[str, Column]:
    return {
        "volume_log": F.log1p("volume"),
        "price_vwap_distance": (F.col("close") - typical()) / (typical() + EPS),
        f"volume_price_corr_{n}": rolling_corr(F.col("volume"), F.col("close"), w, n),
    }


def oscillators(w: WindowSpec) -> dict[str, Column]:
    """Indicators that need no recursion: OBV, CCI 20, Bollinger 20, MFI 14, ROC 10."""
    close, tp = F.col("close"), typical()
    step = F.coalesce(F.signum(close - F.lag(close).over(w)), F.lit(0.0))
    mean, sd = rolling("avg", close, w, 20), rolling("stddev_pop", close, w, 20)
    last = F.collect_list(tp).over(w.rowsBetween(-19, 0))
    middle = rolling("avg", tp, w, 20)
    apart = F.aggregate(last, F.lit(0.0), lambda a, x: a + F.abs(x - middle)) / 20
    return {
        "obv": F.sum(F.coalesce(step, F.lit(0.0)) * F.col("volume")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "cci_20": F.try_divide(tp - middle, 0.015 * apart),
        "bb_upper": mean + 2 * sd,
        "bb_lower": mean - 2 * sd,
    }


def money_flow(bars: DataFrame, n: int = 14, by: str = "ticker", time: str = "bar_date") -> DataFrame:
    """bars with mfi: the share of money that flowed in on rises of the typical price, times 100."""
    w = ordered(by, time)
    flow = typical() * F.col("volume")
    rise = typical() - F.lag(typical()).over(w)
    got = bars.withColumn("__in", F.when(rise > 0, flow).when(rise.isNotNull(), 0.0)).withColumn("__out", F.when(rise < 0, flow).when(rise.isNotNull(), 0.0))
    gain, loss = rolling("sum", F.col("__in"), w, n), rolling("sum", F.col("__out"), w, n)
    return got.withColumn("mfi", 100 * F.try_divide(gain, gain + loss)).drop("__in", "__out")


def lag_pack(columns: list[str], w: WindowSpec, lags: tuple[int, ...] = (1, 5, 10), spans: tuple[int, ...] = (5, 15, 30)) -> dict[str, Column]:
    """Lags, rolling mean and deviation, difference and relative change of columns."""
    out: dict[str, Column] = {}
    for c in columns:
        x = F.col(c)
        out |= {f"{c}_lag_{n}": F.lag(x, n).over(w) for n in lags}
        for n in spans:
            out |= {f"{c}_mean_{n}": rolling("avg", x, w, n), f"{c}_std_{n}": rolling("stddev_samp", x, w, n)}
        out |= {f"{c}_diff": x - F.lag(x).over(w), f"{c}_pct": F.try_divide(x, F.lag(x).over(w)) - 1}
    return out


def daily_features(bars: DataFrame, by: str = "ticker", time: str = "bar_date", counted: DataFrame | None = None) -> DataFrame:
    """All window features of daily bars and the calendar phases: one shuffle, one sort (series of more than scan.CHUNK rows: one more)."""
    w = ordered(by, time)
    made = candles(w) | returns(w) | momentum(w) | volume(w)
    return with_volatility(bars.withColumns(made), by, time, counted=bars if counted is None else counted).select("*", *daily_phases(F.col(time)))
