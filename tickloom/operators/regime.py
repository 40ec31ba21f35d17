"""Market-wide series: one row per date. Every operator takes long rows (ticker, bar_date, ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickloom.functions.scalars import EPS
from tickloom.operators.normalize import rolling_normalised, with_rolling_z
from tickloom.operators.scan import by_series
from tickloom.operators.sliding import counts, ordered_sums
from tickloom.operators.windows import diff, ordered, rolling


def _series(name: Column | None = None):
    """The window over dates of a market-wide series; its rows are one per date."""
    return Window.orderBy("bar_date")


def breadth(rows: DataFrame, value: str, spans: tuple[int, ...] = (5, 20, 60, 200), by: str = "ticker", counted: DataFrame | None = None) -> DataFrame:
    """Share of tickers whose sum of value over the last n rows is above 0, per date. Sums are added up in order, so that their signs do not depend on how windows are cut; counted: as in scan.split()."""

    def kernel(table: pa.Table, place: np.ndarray) -> pa.Table:
        column = table.column("__x")
        known = column.is_valid().to_numpy()
        x = np.where(known, column.to_numpy(), 0.0)
        for n in spans:
            with np.errstate(invalid="ignore"):
                table = table.append_column(f"s{n}", pa.array(ordered_sums(x, n), pa.float64(), mask=(place < n - 1) | (counts(known, n) < n)))
        return table

    wanted = rows.select(by, "bar_date", F.col(value).cast("double").alias("__x"))
    schema = StructType([*wanted.schema.fields, *[StructField(f"s{n}", DoubleType()) for n in spans]])
    sums = by_series(wanted, [by], ["bar_date"], kernel, schema, max(spans) - 1, counted=counted)
    return sums.groupBy("bar_date").agg(*[F.avg((F.col(f"s{n}") > 0).cast("double")).alias(f"breadth_{n}d") for n in spans])


def legs(rows: DataFrame, a: str, b: str, value: str = "close") -> DataFrame:
    """bar_date, a, b: two tickers' values on dates that have both."""
    pick = lambda t, n: rows.where(F.col("ticker") == t).select("bar_date", F.col(value).alias(n))
    return pick(a, "a").join(pick(b, "b"), "bar_date")


def term_structure(rows: DataFrame, short: str, long: str, spans: tuple[int, ...] = (5, 20, 60), n: int = 252) -> DataFrame:
    """Moving averages of ln(short / long), normalised against their own past."""
    w = _series()
    ratio = legs(rows, short, long).withColumn("x", F.ln(F.try_divide("a", F.col("b") + EPS)))
    means = ratio.withColumns({f"term_structure_{k}d": rolling("avg", F.col("x"), w, k) for k in spans})
    names = [f"term_structure_{k}d" for k in spans]
    return with_rolling_z(means.select("bar_date", *names), {c: F.col(c) for c in names}, w, n)


def relative_strength(rows: DataFrame, value: str, benchmark: str, spans: tuple[int, ...] = (5, 20, 60, 252), n: int = 252) -> DataFrame:
    """Per ticker and date: sum of value over the last k rows less the benchmark's, normalised against its own past n rows."""
    w = ordered("ticker", "bar_date")
    sums = rows.select("ticker", "bar_date", *[rolling("sum", F.col(value), w, k).alias(f"s{k}") for k in spans])
    side = sums.where(F.col("ticker") == benchmark).select("bar_date", *[F.col(f"s{k}").alias(f"b{k}") for k in spans])
    raw = sums.join(side, "bar_date", "left").select("ticker", "bar_date", *[(F.col(f"s{k}") - F.col(f"b{k}")).alias(f"rs_{k}d") for k in spans])
    return rolling_normalised(raw, [f"rs_{k}d" for k in spans], n=n)


def ratio_regime(rows: DataFrame, numerator: str, denominator: str, prefix: str, short: int = 5, long: int = 60, step: int = 20) -> DataFrame:
    """ln(numerator / denominator): its short and long averages and the change of the long one. No rows if a leg is missing."""
    w = _series()
    x = legs(rows, numerator, denominator).withColumn("x", F.ln(F.try_divide("a", F.col("b") + EPS)))
    m = x.select("bar_date", rolling("avg", F.col("x"), w, short).alias(f"{prefix}_ma{short}"), rolling("avg", F.col("x"), w, long).alias(f"{prefix}_ma{long}"))
    return m.withColumn(f"{prefix}_delta", diff(F.col(f"{prefix}_ma{long}"), step, w))


# The macro pairs.
MACRO_PAIRS = {"yield_curve": ("TLT", "SHY"), "credit_spread": ("HYG", "LQD"), "size_factor": ("IWM", "SPY"), "growth_factor": ("QQQ", "SPY")}


def macro(rows: DataFrame, pairs: dict[str, tuple[str, str]] = MACRO_PAIRS) -> DataFrame:
    out = None
    for prefix, (a, b) in pairs.items():
        part = ratio_regime(rows, a, b, prefix)
        out = part if out is None else out.join(part, "bar_date", "full")
    return out


def rotation(rows: DataFrame, tickers: list[str], spans: tuple[int, ...] = (60, 200), step: int = 20, n: int = 252, least: int = 2) -> DataFrame:
    """Spread of the tickers' n-day log returns per date, sample deviation and range, normalised; change of the longest."""
    w = ordered("ticker", "bar_date")
    r = rows.where(F.col("ticker").isin(tickers)).select("bar_date", *[F.ln(F.try_divide("close", F.lag("close", k).over(w))).alias(f"r{k}") for k in spans])
    by = r.groupBy("bar_date").agg(
        *[F.when(F.count(f"r{k}") >= least, F.stddev_samp(f"r{k}")).alias(f"rotation_std_{k}") for k in spans],
        *[F.when(F.count(f"r{k}") >= least, F.max(f"r{k}") - F.min(f"r{k}")).alias(f"rotation_range_{k}") for k in spans],
    )
    names = [f"rotation_{kind}_{k}" for kind in ("std", "range") for k in spans]
    z = with_rolling_z(by.select("bar_date", *names), {c: F.col(c) for c in names}, _series(), n)
    return z.withColumns({f"rotation_{kind}_{spans[-1]}_delta": diff(F.col(f"rotation_{kind}_{spans[-1]}"), step, _series()) for kind in ("std", "range")})


def regime_deltas(rows: DataFrame, short: list[str], long: list[str]) -> DataFrame:
    """column_delta_n: n of 1, 5, 20 for short bases, 20, 60 for long ones."""
    w = _series()
    return rows.withColumns({f"{c}_delta_{n}": diff(F.col(c), n, w) for cs, ns in ((short, (1, 5, 20)), (long, (20, 60))) for c in cs for n in ns})


def regime_table(
    rows: DataFrame, value: str, volatility_pair: tuple[str, str], pairs: dict[str, tuple[str, str]], sectors: list[str],
    spans: tuple[int, ...] = (5, 20, 60, 200), terms: tuple[int, ...] = (5, 20, 60), rotations: tuple[int, ...] = (60, 200), n: int = 252,
) -> DataFrame:
    """All market-wide columns of a date in one table: breadth and term structure with their deltas, ratio families, rotation.

    With the default spans and four pairs 45 columns. rows: ticker, bar_date, close and value (log return). One row per date of
    breadth; a family without rows on a date, or with a missing leg, is null there.
    """
    wide = breadth(rows, value, spans)
    wide = regime_deltas(wide, [f"breadth_{k}d" for k in spans[:-1]], [f"breadth_{spans[-1]}d"])
    term = term_structure(rows, *volatility_pair, spans=terms, n=n)
    term = regime_deltas(term, [f"term_structure_{k}d" for k in terms], [])
    for part in (term, macro(rows, pairs), rotation(rows, sectors, rotations, n=n)):
        wide = wide.join(part, "bar_date", "left")
    return wide


def trend_states(rows: DataFrame, benchmark: str, q: float = 0.5) -> DataFrame:
    """state 0 to 3 per date: trend (50-day average above the 200-day one) and realised volatility above its past quantile."""
    from tickloom.operators.windows import rolling_quantile

    w = _series()
    x = rows.where(F.col("ticker") == benchmark).select("bar_date", "close").withColumn("r", F.ln("close") - F.ln(F.lag("close").over(w)))
    x = x.withColumn("vol", rolling("stddev_samp", F.col("r"), w, 20)).withColumn("limit", rolling_quantile(F.col("vol"), q, w, 252, 1))
    up = rolling("avg", F.col("close"), w, 50) > rolling("avg", F.col("close"), w, 200)
    return x.select("bar_date", (2 * up.cast("int") + (F.col("vol") > F.col("limit")).cast("int")).alias("state"))
