"""Normalisation over time and across the universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.scalars import EPS, clipped
from tickloom.operators.order_stats import rolling_scores
from tickloom.operators.windows import diff, ordered, trailing


def with_rolling_z(df: DataFrame, columns: dict[str, Column], w: WindowSpec, n: int = 252, low: float = 0.01, high: float = 0.99, mode: str = "linear") -> DataFrame:
    """Columns set to tanh of the z-score of values against the n rows before, held within their quantiles first; 0 while there are fewer.

    For market-wide series of a row a date; long tables have rolling_normalised(). Only earlier rows enter, so nothing looks ahead. A null value stays null once the rows suffice. Each statistic of a frame
    is computed once and named (Spark evaluates every mention of a window expression anew), both quantiles from one pass.
    """
    frame = trailing(w, n, 1)
    stats: dict[str, Column] = {}
    for name, x in columns.items():
        stats |= {f"__n_{name}": F.count(x).over(frame), f"__m_{name}": F.avg(x).over(frame), f"__d_{name}": F.stddev_samp(x).over(frame), f"__x_{name}": x}
        stats[f"__q_{name}"] = F.percentile(x, F.array(F.lit(low), F.lit(high))).over(frame) if mode == "linear" else F.array_sort(F.collect_list(x).over(frame))
    out = df.withColumns(stats)

    def z(name: str) -> Column:
        x, q = F.col(f"__x_{name}"), F.col(f"__q_{name}")
        at = (0, 1) if mode == "linear" else (int((n - 1) * low + 0.5), int((n - 1) * high + 0.5))
        held = F.when(x.isNotNull(), F.greatest(F.get(q, F.lit(at[0])), F.least(F.get(q, F.lit(at[1])), x)))
        score = F.tanh((held - F.col(f"__m_{name}")) / F.greatest(F.col(f"__d_{name}"), F.lit(EPS)))
        return F.when(F.col(f"__n_{name}") < n, 0.0).otherwise(score)

    return out.withColumns({name: z(name) for name in columns}).drop(*stats)


def rolling_normalised(df: DataFrame, columns: list[str], by: str = "ticker", time: str = "bar_date", n: int = 252, mode: str = "linear", counted: DataFrame | None = None) -> DataFrame:
    """with_rolling_z of each column in place (order_stats). counted: as in scan.split()."""
    return rolling_scores(df, columns, n, by=by, time=time, mode=mode, counted=counted)


def deltas(df: DataFrame, steps: dict[str, list[int]], by: str = "ticker", time: str = "bar_date") -> DataFrame:
    """column_delta_n for each column and n."""
    w = ordered(by, time)
    return df.withColumns({f"{c}_delta_{n}": diff(F.col(c), n, w) for c, ns in steps.items() for n in ns})


def _z(x: Column, over: WindowSpec) -> Column:
    sd = F.stddev_pop(x).over(over)
    return F.tanh((x - F.avg(x).over(over)) / F.when(sd < EPS, 1.0).otherwise(sd))


def cross_section(df: DataFrame, columns: list[str], time: str = "bar_date", sector: str | None = None, by: str = "ticker") -> DataFrame:
    """column_cs_zscore across all rows of a time and, with a sector column, column_sector_zscore among its peers.

    Sectors with fewer than two tickers overall have no sector score (0).
    """
    out = df.withColumns({f"{c}_cs_zscore": _z(F.col(c), Window.partitionBy(time)) for c in columns})
    if sector is None:
        return out
    peers = df.groupBy(sector).agg(F.countDistinct(by).alias("__peers"))
    out = out.join(F.broadcast(peers), sector, "left")
    return out.withColumns({f"{c}_sector_zscore": F.when(F.col("__peers") >= 2, _z(F.col(c), Window.partitionBy(time, sector))).otherwise(0.0) for c in columns}).drop("__peers")


def fitted_scaler(df: DataFrame, columns: list[str], fit_on: Column, limit: float = 5.0) -> DataFrame:
    """columns scaled by mean and population deviation of the rows fit_on holds for, within +-limit."""
    stats = df.where(fit_on).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    out = df.withColumn("__one", F.lit(1)).join(F.broadcast(stats.withColumn("__one", F.lit(1))), "__one").drop("__one")  # one row
    return out.withColumns({c: clipped((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0), -limit, limit) for c in columns}).drop(*stats.columns)
