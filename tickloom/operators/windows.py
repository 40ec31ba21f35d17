"""Window toolkit. Frames count rows; statistics are null until their frame is full, as asked by `full`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.scalars import neutralised


def ordered(by: list[str] | str, *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)


def trailing(w: WindowSpec, n: int, lag: int = 0) -> WindowSpec:
    """The n rows that end lag rows before the current one."""
    return w.rowsBetween(-(n - 1) - lag, -lag)


def full(value: Column, x: Column, frame: WindowSpec, n: int) -> Column:
    return F.when(F.count(x).over(frame) == n, value)


def rolling(kind: str, x: Column, w: WindowSpec, n: int, lag: int = 0) -> Column:
    """kind: avg, sum, stddev_samp, stddev_pop, min, max."""
    frame = trailing(w, n, lag)
    return full(getattr(F, kind)(x).over(frame), x, frame, n)


def rolling_quantile(x: Column, q: float, w: WindowSpec, n: int, lag: int = 0, mode: str = "linear") -> Column:
    """mode: linear interpolation, or the nearest rank (half up)."""
    frame = trailing(w, n, lag)
    if mode == "linear":
        return full(F.percentile(x, F.lit(q)).over(frame), x, frame, n)
    return full(F.get(F.array_sort(F.collect_list(x).over(frame)), F.lit(int((n - 1) * q + 0.5))), x, frame, n)


def correlation(a: Column, b: Column, over: WindowSpec | None = None) -> Column:
    """Pearson's r of the rows that have both; null without variance (corr() raises there in ANSI mode)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    cov, sx, sy = (p.over(over) for p in parts) if over is not None else parts
    return F.try_divide(cov, sx * sy)


def rolling_corr(a: Column, b: Column, w: WindowSpec, n: int) -> Column:
    """Clipped to [-1, 1]; 0 where it is not defined."""
    frame = trailing(w, n)
    both = F.when(a.isNotNull() & b.isNotNull(), 1)
    flat = (F.min(a).over(frame) == F.max(a).over(frame)) | (F.min(b).over(frame) == F.max(b).over(frame))
    c = F.when((F.count(both).over(frame) == n) & ~flat, correlation(a, b, frame))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), neutralised(c)))


def diff(x: Column, n: int, w: WindowSpec) -> Column:
    """x less x n rows ago; 0 where there is none."""
    return F.coalesce(x - F.lag(x, n).over(w), F.lit(0.0))


def forward_filled(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def islands(df: DataFrame, starts: Column, w: WindowSpec, name: str = "island") -> DataFrame:
    """Numbers the stretches that begin where starts is true (a null counts as true), from 0 within a partition."""
    begins = F.coalesce(starts, F.lit(True)).cast("int")
    return df.withColumn(name, F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.first(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def since_change(df: DataFrame, changed: Column, w: WindowSpec, by: list[str], order: list[str], name: str = "since_change") -> DataFrame:
    """Rows since the last row at which changed was true."""
    marked = df.withColumn("__run", F.sum(F.coalesce(changed, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn(name, F.row_number().over(ordered([*by, "__run"], *order)) - 1).drop("__run")


def positions(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """since_open, to_close: rows from either end of a partition, and both as shares."""
    n = F.count("*").over(Window.partitionBy(*by))
    at = F.row_number().over(ordered(by, *order)) - 1
    return df.withColumn("since_open", at).withColumn("to_close", n - 1 - F.col("since_open")).withColumn("session_share", F.try_divide(F.col("since_open"), n - 1))


def drawdown(x: Column, w: WindowSpec) -> Column:
    top = F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.try_divide(top - x, top)


def running_product(x: Column, w: WindowSpec) -> Column:
    return F.product(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def observation(x: Column, w: WindowSpec, n: int) -> Column:
    """The last n values as an array, zeros in front where the series is shorter."""
    got = F.collect_list(F.coalesce(x, F.lit(0.0))).over(w.rowsBetween(-(n - 1), 0))
    return F.concat(F.array_repeat(F.lit(0.0), F.lit(n) - F.size(got)), got)
