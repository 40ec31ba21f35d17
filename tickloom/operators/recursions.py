"""Recursive averages as a scan: y = (1 - alpha) y + alpha x over series of any length, in chunks.

Over a chunk a recursion is an affine map of the state that enters it: while fewer than `seeds` values have been seen the state is
their sum, at the last of them it becomes the mean that starts the average, and from then on it is the average itself. So
1. values are counted by chunk and summed up in order (a row a chunk), which tells each chunk where the average starts,
2. each chunk gives its map (a, b), a task a chunk,
3. the maps of a series are applied one after the other (a row a chunk) and give each chunk the state that enters it,
4. each chunk computes its rows from that state.
A series of 10^9 rows is 10^5 chunks, in as many tasks as there are; only rows of step 3 meet by series.

The indicators do series of at most a chunk whole, many at once (whole_averages); only longer ones take these steps.

Nulls and NaN are no values: the average stays as it is. It is null until it starts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tickloom.operators.scan import CHUNK, by_chunks, by_packs, materialised, placed, split
from tickloom.operators.sliding import smallest

EPS = 1e-8


@dataclass(frozen=True)
class Average:
    """column's average, begun by the sum of its first `seeds` values over `divisor`; `scale` times it is returned, and the first one not if `late`."""

    column: str
    seeds: int
    divisor: float
    alpha: float
    scale: float = 1.0
    late: bool = False


def ema(column: str, n: int) -> Average:
    return Average(column, n, n, 2 / (n + 1))


def wilder(column: str, n: int) -> Average:
    return Average(column, n, n, 1 / n)


def wilder_sum(column: str, n: int) -> Average:
    """s - s/n + x, begun by the first n - 1 values and returned from the next one on."""
    return Average(column, n - 1, n, 1 / n, n, True)


def _decayed(values: np.ndarray, alpha: float) -> float:
    """What values leave in an average that was 0."""
    return float(alpha * ((1 - alpha) ** np.arange(len(values) - 1, -1, -1) @ values))


def chunk_map(x: np.ndarray, seen: int, avg: Average) -> tuple[float, float]:
    """(a, b): a chunk that is entered with state s is left with a s + b. seen: values before the chunk."""
    v = x[~np.isnan(x)]
    if seen >= avg.seeds:
        return (1 - avg.alpha) ** len(v), _decayed(v, avg.alpha)
    head, tail = v[: avg.seeds - seen], v[avg.seeds - seen :]
    if seen + len(head) < avg.seeds:
        return 1.0, float(head.sum())
    keep = (1 - avg.alpha) ** len(tail) / avg.divisor
    return keep, keep * float(head.sum()) + _decayed(tail, avg.alpha)


def chunk_values(x: np.ndarray, seen: int, state: float, avg: Average) -> np.ndarray:
    """The average at each row of a chunk that is entered with state."""
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(~np.isnan(x))
    v = x[at]
    need = max(0, avg.seeds - seen)
    if need > len(v):
        return out
    begin = state if not need else (state + v[:need].sum()) / avg.divisor
    run = pd.Series(np.concatenate([[begin], v[need:]])).ewm(alpha=avg.alpha, adjust=False).mean().to_numpy() * avg.scale
    if need:
        out[at[need - 1 :]] = run
    else:
        out[at] = run[1:]
    begins = at[need - 1] if need else 0
    if not need and np.isnan(out[:1]).any():
        out[0] = run[0]
    out[begins:] = pd.Series(out[begins:]).ffill()
    if need and avg.late:
        out[begins : at[need] if need < len(at) else len(x)] = np.nan
    if avg.late and seen == avg.seeds:
        out[: at[0] if len(at) else len(x)] = np.nan
    return out


def whole_averages(columns: dict[str, np.ndarray], place: np.ndarray, averages: dict[str, Average]) -> dict[str, np.ndarray]:
    """The averages of whole series that lie one after another, a step at a time for all of them. place: of each value in its series."""
    starts = np.flatnonzero(place == 0)
    sizes = np.diff(np.append(starts, len(place)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    specs = list(averages.values())
    x = np.column_stack([columns[a.column] for a in specs])
    seeds, divisor, alpha, scale = (np.array([getattr(a, k) for a in specs], float) for k in ("seeds", "divisor", "alpha", "scale"))
    shown, keep = seeds + np.array([a.late for a in specs]), 1 - alpha
    seen, state = np.zeros((len(starts), len(specs))), np.zeros((len(starts), len(specs)))
    out = np.empty_like(x)
    lasting = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0))
    with np.errstate(invalid="ignore", over="ignore"):
        for t, n in enumerate(lasting):
            at = starts[:n] + t
            v, s, m = x[at], state[:n], seen[:n]
            known = v == v
            m += known
            if known.all() and (m > shown).all():
                s *= keep
                s += alpha * v
                out[at] = s * scale
                continue
            next_ = np.where(m > seeds, keep * s + alpha * v, np.where(m == seeds, (s + v) / divisor, s + v))
            s[:] = np.where(known, next_, s)
            out[at] = np.where(m >= shown, s * scale, np.nan)
    return {name: out[:, i] for i, name in enumerate(averages)}


def averaged(rows: DataFrame, averages: dict[str, Average], by: list[str], position: str = "position", chunk: int = CHUNK) -> DataFrame:
    """rows with the averages, by name. rows: placed(), read three times."""
    columns = sorted({a.column for a in averages.values()})
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = rows.withColumn("__chunk", F.floor(F.col(position) / chunk))
    counts = rows.groupBy(*by, "__chunk").agg(*[F.count(clean(c)).alias(c) for c in columns])
    earlier = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "__chunk"]
    theirs = [f"__of_{c}" for c in keys]
    seen = materialised(counts.select(*[F.col(c).alias(t) for c, t in zip(keys, theirs, strict=True)], F.array(*[F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in columns]).alias("__seen")))
    specs = [(a, columns.index(a.column)) for a in averages.values()]
    key_fields = [StructField(t, rows.schema[c].dataType) for c, t in zip(keys, theirs, strict=True)]
    values = lambda table, c: table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)

    def maps(table: pa.Table, state: pa.Table) -> pa.Table:
        table = table.sort_by(position)
        x = {c: values(table, c) for c in columns}
        n = state.column("__seen")[0].as_py()
        got = [chunk_map(x[a.column], n[i], a) for a, i in specs]
        return state.select(theirs).append_column("a", pa.array([[g[0] for g in got]])).append_column("b", pa.array([[g[1] for g in got]]))

    def carried(table: pa.Table) -> pa.Table:
        """A row a chunk of one series."""
        table = table.sort_by("__of___chunk")
        a, b = (np.array(table.column(c).to_pylist()) for c in ("a", "b"))
        out = np.zeros_like(a)
        for k in range(1, len(a)):
            out[k] = a[k - 1] * out[k - 1] + b[k - 1]
        return table.select(theirs).append_column("__state", pa.array(out.tolist(), pa.list_(pa.float64())))

    def computed(table: pa.Table, state: pa.Table) -> pa.Table:
        table = table.sort_by(position)
        n, s = state.column("__seen")[0].as_py(), state.column("__state")[0].as_py()
        out = table.drop_columns("__chunk")
        for k, (name, (a, i)) in enumerate(zip(averages, specs, strict=True)):
            got = chunk_values(values(table, a.column), n[i], s[k], a)
            out = out.append_column(name, pa.array(got, pa.float64(), from_pandas=True))
        return out

    numbers = ArrayType(DoubleType())
    needed = rows.select(*keys, position, *columns)
    found = needed.groupBy(*keys).cogroup(seen.groupBy(*theirs)).applyInArrow(maps, StructType([*key_fields, StructField("a", numbers), StructField("b", numbers)]))
    states = found.groupBy(*theirs[:-1]).applyInArrow(carried, StructType([*key_fields, StructField("__state", numbers)]))
    states = states.withColumnsRenamed({t: f"{t}_2" for t in theirs})
    same = F.lit(True)
    for t in theirs:
        same &= F.col(t).eqNullSafe(F.col(f"{t}_2"))
    both = seen.join(states, same).drop(*[f"{t}_2" for t in theirs])
    schema = StructType([*[f for f in rows.schema.fields if f.name != "__chunk"], *[StructField(name, DoubleType()) for name in averages]])
    return rows.groupBy(*keys).cogroup(both.groupBy(*theirs)).applyInArrow(computed, schema)


# ---- indicators


MOVES = ("tr", "tr0", "plus", "minus", "gain", "loss")


def _values(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _sized(bars: DataFrame, by: str, time: str) -> DataFrame:
    """by, time and numbers of bars as doubles, with size and range of a trade."""
    per = F.greatest(F.col("transactions"), F.lit(1.0))
    numbers = bars.select(by, time, *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume", "transactions")])
    return numbers.withColumns({"trade_size": F.col("volume") / per, "trade_range": (F.col("high") - F.col("low")) / per})


def _moves(table: pa.Table, place: np.ndarray) -> dict[str, np.ndarray]:
    """What the indicators average: true range (tr from the second bar on, tr0 from the first), directional moves, gains and losses. place: of each bar in its series."""
    high, low, close = (_values(table, c) for c in ("high", "low", "close"))
    last = lambda x: np.where(place == 0, np.nan, np.roll(x, 1))
    before = last(close)
    up, down, change = high - last(high), last(low) - low, close - before
    known = ~np.isnan(change)
    with np.errstate(invalid="ignore"):
        tr = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
        plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        return {"tr": tr, "tr0": np.fmax(tr, high - low), "plus": np.where(known, plus, np.nan), "minus": np.where(known, minus, np.nan), "gain": np.maximum(change, 0), "loss": np.maximum(-change, 0)}


def moves(bars: DataFrame, by: str, time: str, chunk: int = CHUNK) -> DataFrame:
    """Placed _sized() bars with their _moves()."""

    def kernel(table: pa.Table, place: np.ndarray) -> pa.Table:
        for name, x in _moves(table, place).items():
            table = table.append_column(name, pa.array(x, pa.float64(), from_pandas=True))
        return table

    rows = placed(bars, [by], [time])
    return materialised(by_chunks(rows, [by], kernel, StructType([*rows.schema.fields, *[StructField(n, DoubleType()) for n in MOVES]]), 1, chunk))


def _log(a: str, b: str) -> Column:
    return F.ln(F.try_divide(F.col(a) + EPS, F.col(b) + EPS))


def _index(n: int) -> dict[str, Column]:
    """Directional indicators of n bars from Wilder's sums, 0 to 100, and how far they are apart."""
    p, m = (F.coalesce(F.try_divide(100 * F.col(f"{s}_{n}"), F.col(f"tr_{n}")), F.when(F.col(f"tr_{n}").isNotNull(), 0.0)) for s in ("plus", "minus"))
    return {f"pdi_{n}": p, f"mdi_{n}": m, f"dx_{n}": F.when(p + m > 0, 100 * F.abs(p - m) / (p + m)).when(F.col(f"tr_{n}").isNotNull(), 0.0)}


def _whole_index(found: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """_index() of arrays."""
    tr = found[f"tr_{n}"]
    p, m = (np.where(tr != 0, 100 * found[f"{s}_{n}"] / tr, 0.0) for s in ("plus", "minus"))
    return {f"pdi_{n}": p, f"mdi_{n}": m, f"dx_{n}": np.where(p + m > 0, 100 * np.abs(p - m) / (p + m), np.where(np.isnan(tr), np.nan, 0.0))}


def _directional(
    bars: DataFrame, spans: tuple[int, ...], averages: dict[str, Average], further: Callable[[DataFrame], DataFrame], whole_further: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]],
    more: dict[str, Average], names: list[str], by: str, time: str, chunk: int, counted: DataFrame | None, last: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """bars with the averages, dx of each span and, of these and of `more`, the second averages, by `names`.

    Series of at most `chunk` rows are done whole, in one pass; the others in chunks, by further() and, at the end, last() instead of whole_further().
    """
    first = averages | {f"{s}_{n}": wilder_sum(s, n) for n in spans for s in ("tr", "plus", "minus")}
    second = {f"adx_{n}": wilder(f"dx_{n}", n) for n in spans} | more
    rows = _sized(bars, by, time)

    def kernel(table: pa.Table, place: np.ndarray) -> pa.Table:
        found = {c: _values(table, c) for c in ("high", "low", "close", "volume", "transactions", "trade_size", "trade_range")} | _moves(table, place)
        found |= whole_averages(found, place, first)
        with np.errstate(invalid="ignore", divide="ignore"):
            found |= whole_further(found, place)
            for n in spans:
                found |= _whole_index(found, n)
        found |= whole_averages(found, place, second)
        for name in names:
            table = table.append_column(name, pa.array(found[name], pa.float64(), from_pandas=True))
        return table

    short, large = split(rows, [by], chunk, counted)
    schema = StructType([*rows.schema.fields, *[StructField(name, DoubleType()) for name in names]])
    got = by_packs(short, [by], [time], kernel, schema)
    if large is None:
        return got
    chunked = averaged(moves(large, by, time, chunk), first, [by], chunk=chunk)
    held = materialised(further(chunked).withColumns({k: c for n in spans for k, c in _index(n).items()}))
    return got.unionByName(last(averaged(held, second, [by], chunk=chunk)).select(got.columns))


def trend(bars: DataFrame, by: str = "ticker", time: str = "bar_date", chunk: int = CHUNK, counted: DataFrame | None = None) -> DataFrame:
    """by, time and log ratios of prices, volumes and trade sizes to their averages, and of averages to each other; ADX. counted: as in scan.split()."""
    spans = {"close": (5, 20, 60, 120, 252), "volume": (5, 20, 60), "trade_size": (60,), "trade_range": (60,), "transactions": (60,)}
    averages = {f"{c}_ema_{n}": ema(c, n) for c, ns in spans.items() for n in ns}
    directions = (5, 14, 20, 60)
    got = _directional(bars, directions, averages, lambda df: df, lambda found, place: {}, {}, [*averages, *(f"adx_{n}" for n in directions)], by, time, chunk, counted)
    out = {f"ema_close_ratio_{n}": _log("close", f"close_ema_{n}") for n in spans["close"]}
    out |= {f"ema_{a}_{b}_ratio": _log(f"close_ema_{a}", f"close_ema_{b}") for a, b in ((5, 20), (20, 60))}
    out |= {"adx_14": F.col("adx_14") / 100, "adx_5_20": _log("adx_5", "adx_20"), "adx_20_60": _log("adx_20", "adx_60")}
    out |= {"volume_ema_ratio_20": _log("volume", "volume_ema_20")} | {f"volume_{a}_{b}_ratio": _log(f"volume_ema_{a}", f"volume_ema_{b}") for a, b in ((5, 20), (20, 60))}
    out |= {"avg_trade_size_ratio": _log("trade_size", "trade_size_ema_60"), "range_per_trade_ratio": _log("trade_range", "trade_range_ema_60"), "trade_intensity_ratio": _log("transactions", "transactions_ema_60")}
    return got.select(by, time, *[c.alias(n) for n, c in out.items()])


def classic(bars: DataFrame, by: str = "ticker", time: str = "bar_date", chunk: int = CHUNK, counted: DataFrame | None = None) -> DataFrame:
    """by, time, RSI and its place in its last 14 values, MACD and its signal, directional indicators of 20, ATR of 14, EMAs of 3, 9 and 21."""
    averages = {f"ema_{n}": ema("close", n) for n in (3, 9, 12, 21, 26)} | {"up_14": wilder("gain", 14), "down_14": wilder("loss", 14), "atr_14": wilder("tr", 14)}
    both = F.col("up_14") + F.col("down_14")

    def further(df: DataFrame) -> DataFrame:
        return df.withColumns({"macd": F.col("ema_12") - F.col("ema_26"), "rsi_14": F.when(both > 0, 100 * F.col("up_14") / both).when(both.isNotNull(), 0.0)})

    def stochastic(r: np.ndarray, place: np.ndarray) -> np.ndarray:
        low, high = smallest(r, 14, 1)[0], -smallest(-r, 14, 1)[0]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where((place >= 13) & (high > low), (r - low) / (high - low), np.nan)

    def whole_further(found: dict[str, np.ndarray], place: np.ndarray) -> dict[str, np.ndarray]:
        up, both = found["up_14"], found["up_14"] + found["down_14"]
        rsi = np.where(both > 0, 100 * up / both, np.where(np.isnan(both), np.nan, 0.0))
        return {"macd": found["ema_12"] - found["ema_26"], "rsi_14": rsi, "stoch_rsi": stochastic(rsi, place)}

    def last(df: DataFrame) -> DataFrame:
        kernel = lambda table, place: table.append_column("stoch_rsi", pa.array(stochastic(_values(table, "rsi_14"), place), pa.float64(), from_pandas=True))
        return by_chunks(df, [by], kernel, StructType([*df.schema.fields, StructField("stoch_rsi", DoubleType())]), 13, chunk)

    names = ["rsi_14", "stoch_rsi", "macd", "macd_signal", "pdi_20", "mdi_20", "adx_20", "atr_14", "ema_3", "ema_9", "ema_21"]
    got = _directional(bars, (20,), averages, further, whole_further, {"macd_signal": ema("macd", 9)}, names, by, time, chunk, counted, last)
    return got.select(by, time, "rsi_14", "macd", "macd_signal", F.col("pdi_20").alias("plus_di_20"), F.col("mdi_20").alias("minus_di_20"), "adx_20", "atr_14", "ema_3", "ema_9", "ema_21", "stoch_rsi")
