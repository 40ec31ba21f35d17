"""Rolling order statistics, all columns in one pass over series or chunks of long ones.

Quantiles near the ends of a window come from its few smallest and largest values, by array operations over many series at once.
For others a sorted window keeps its values in order; a value that enters or leaves is placed by bisection, and a quantile is read by its rank.
The work is rows x log window steps. Series of any length are done (scan.by_series): chunks of long ones carry the window's rows
before them along.

Nulls and NaN are no values; a statistic is null until its window holds n of them.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from tickloom.functions.scalars import EPS
from tickloom.operators.scan import CHUNK, by_series
from tickloom.operators.sliding import counts, moments, shifted, smallest

#: The most values from an end of a window that are kept for a quantile.
TAIL = 8


class SortedWindow:
    """Values in order, with their quantiles."""

    def __init__(self):
        self.values: list[float] = []

    def __len__(self) -> int:
        return len(self.values)

    def add(self, x: float) -> None:
        insort(self.values, x)

    def drop(self, x: float) -> None:
        del self.values[bisect_left(self.values, x)]

    def quantile(self, q: float, mode: str = "linear") -> float:
        """By linear interpolation, or the nearest rank (half up)."""
        at = (len(self.values) - 1) * q
        if mode != "linear":
            return self.values[int(at + 0.5)]
        low = int(at)
        return self.values[low] + (self.values[low + 1] - self.values[low]) * (at - low) if at > low else self.values[low]


def window_quantiles(x: np.ndarray, n: int, qs: list[float], lag: int = 0, mode: str = "linear") -> np.ndarray:
    """A row a quantile: of the n values that end lag before each. NaN where the window is not full."""
    out = np.full((len(qs), len(x)), np.nan)
    window = SortedWindow()
    values = x.tolist()
    for i in range(lag, len(values)):
        new = values[i - lag]
        if new == new:
            window.add(new)
        if i - lag >= n:
            old = values[i - lag - n]
            if old == old:
                window.drop(old)
        if len(window) == n:
            for k, q in enumerate(qs):
                out[k, i] = window.quantile(q, mode)
    return out


def series_quantiles(x: np.ndarray, place: np.ndarray, n: int, qs: list[float], lag: int = 0, mode: str = "linear") -> np.ndarray:
    """window_quantiles() of series that lie one after another. place: of each value in its series.

    Quantiles near either end are read from the few smallest or largest values of each window (sliding.smallest), others from sorted windows.
    """
    ranks = [int((n - 1) * q) if mode == "linear" else int((n - 1) * q + 0.5) for q in qs]
    parts = [(n - 1) * q - r if mode == "linear" else 0.0 for q, r in zip(qs, ranks, strict=True)]
    out = np.full((len(qs), len(x)), np.nan)
    ends: dict[bool, list[int]] = {False: [], True: []}
    middle = []
    for i, (r, part) in enumerate(zip(ranks, parts, strict=True)):
        top = n - 1 - r < r
        needed = n - r if top else r + 1 + (part > 0)
        (ends[top] if needed <= TAIL else middle).append(i)
    for top, which in ends.items():
        if not which:
            continue
        needed = max(n - ranks[i] if top else ranks[i] + 1 + (parts[i] > 0) for i in which)
        found = smallest(-x if top else x, n, 1 << (needed - 1).bit_length())
        rank = lambda r: -found[n - 1 - r] if top else found[r]  # noqa: B023, E731
        for i in which:
            low = rank(ranks[i])
            out[i] = low + (rank(ranks[i] + 1) - low) * parts[i] if parts[i] > 0 else low
    for i in range(len(qs)):
        out[i] = shifted(out[i], lag)
    if middle:
        out[middle] = window_quantiles(x, n, [qs[i] for i in middle], lag, mode)
    whole = (place >= n - 1 + lag) & (shifted(counts(~np.isnan(x), n).astype(float), lag) == n)
    out[:, ~whole] = np.nan
    return out


def _values(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _column(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), from_pandas=True)


def rolling_order(df: DataFrame, columns: list[str], n: int, qs: dict[str, float], by: str = "ticker", time: str = "bar_date", lag: int = 0, mode: str = "linear", chunk: int = CHUNK) -> DataFrame:
    """df with {column}_{name} for each column and each named quantile."""
    names = [f"{c}_{name}" for c in columns for name in qs]

    def kernel(table: pa.Table, place: np.ndarray) -> pa.Table:
        for c in columns:
            for name, x in zip(qs, series_quantiles(_values(table, c), place, n, list(qs.values()), lag, mode), strict=True):
                table = table.append_column(f"{c}_{name}", _column(x))
        return table

    schema = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in names]])
    return by_series(df, [by], [time], kernel, schema, n - 1 + lag, chunk)


def rolling_scores(
    df: DataFrame, columns: list[str], n: int = 252, low: float = 0.01, high: float = 0.99, by: str = "ticker", time: str = "bar_date", mode: str = "linear", chunk: int = CHUNK, counted: DataFrame | None = None,
) -> DataFrame:
    """df with each column replaced by tanh of its z-score against the n rows before, held within their quantiles first; 0 while there are fewer.

    Only earlier rows enter. A null stays null once its window is full. All columns are done in one pass over the rows.
    counted: rows of the same keys that cost less to count.
    """

    def scored(x: np.ndarray, place: np.ndarray) -> np.ndarray:
        bottom, top = series_quantiles(x, place, n, [low, high], 1, mode)
        mean, m2 = (shifted(v, 1) for v in moments(x, n))
        with np.errstate(invalid="ignore"):
            deviation = np.sqrt(m2 / (n - 1)) if n > 1 else np.full(len(x), np.nan)
            z = np.tanh((np.maximum(bottom, np.minimum(top, x)) - mean) / np.maximum(deviation, EPS))
        return np.where(np.isnan(bottom), 0.0, z)

    def kernel(table: pa.Table, place: np.ndarray) -> pa.Table:
        for c in columns:
            table = table.set_column(table.schema.get_field_index(c), c, _column(scored(_values(table, c), place)))
        return table

    schema = StructType([StructField(f.name, DoubleType()) if f.name in columns else f for f in df.schema.fields])
    return by_series(df, [by], [time], kernel, schema, n, chunk, counted)
