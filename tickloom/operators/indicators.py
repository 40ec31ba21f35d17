"""Recursive indicators, one grouped pass per ticker: each recursion is a short Arrow-fed kernel over the series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EPS = 1e-8


def _recursion(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """y = (1 - alpha) y + alpha x, begun by the mean of the first n defined values; NaN before."""
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(~np.isnan(x))
    if len(at) < n:
        return out
    start = at[0] + n - 1
    tail = np.concatenate([[x[at[0] : start + 1].mean()], x[start + 1 :]])
    out[start:] = pd.Series(tail).ewm(alpha=alpha, adjust=False).mean()
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return _recursion(x, n, 2 / (n + 1))


def wilder_sum(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's running sum: the first n - 1 changes added up, then s - s/n + x. x[0] is no change."""
    out = np.full(len(x), np.nan)
    if len(x) > n:
        tail = np.concatenate([[x[1:n].sum() / n], x[n:]])
        out[n - 1 :] = pd.Series(tail).ewm(alpha=1 / n, adjust=False).mean() * n
        out[n - 1] = np.nan
    return out


def directional(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(+DI, -DI, ADX), each 0 to 100."""
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    before = np.concatenate([[np.nan], close[:-1]])
    true_range = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = wilder_sum(true_range, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, m = 100 * wilder_sum(plus, n) / tr, 100 * wilder_sum(minus, n) / tr
        dx = np.where(p + m > 0, 100 * np.abs(p - m) / (p + m), np.where(np.isnan(tr), np.nan, 0.0))
    return p, m, _recursion(dx, n, 1 / n)


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    change = np.diff(close, prepend=np.nan)
    gain, loss = (_recursion(np.where(np.isnan(change), np.nan, np.maximum(s * change, 0)), n, 1 / n) for s in (1, -1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(gain + loss > 0, 100 * gain / (gain + loss), np.where(np.isnan(gain), np.nan, 0.0))


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    tr = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    return _recursion(tr, n, 1 / n)


def _log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log((a + EPS) / (b + EPS))


def trend_columns(f: pd.DataFrame) -> dict[str, np.ndarray]:
    """Of one ticker's bars in time order."""
    high, low, close, volume, trades = (f[c].to_numpy(float) for c in ("high", "low", "close", "volume", "transactions"))
    out: dict[str, np.ndarray] = {}
    emas = {n: ema(close, n) for n in (5, 20, 60, 120, 252)}
    out |= {f"ema_close_ratio_{n}": _log(close, e) for n, e in emas.items()}
    out |= {"ema_5_20_ratio": _log(emas[5], emas[20]), "ema_20_60_ratio": _log(emas[20], emas[60])}
    adx = {n: directional(high, low, close, n)[2] for n in (5, 14, 20, 60)}
    out |= {"adx_14": adx[14] / 100, "adx_5_20": _log(adx[5], adx[20]), "adx_20_60": _log(adx[20], adx[60])}
    v = {n: ema(volume, n) for n in (5, 20, 60)}
    out |= {"volume_ema_ratio_20": _log(volume, v[20]), "volume_5_20_ratio": _log(v[5], v[20]), "volume_20_60_ratio": _log(v[20], v[60])}
    per = np.maximum(trades, 1)
    for name, x in (("avg_trade_size_ratio", volume / per), ("range_per_trade_ratio", (high - low) / per), ("trade_intensity_ratio", trades)):
        out[name] = _log(x, ema(x, 60))
    return out


def classic_columns(f: pd.DataFrame) -> dict[str, np.ndarray]:
    high, low, close = (f[c].to_numpy(float) for c in ("high", "low", "close"))
    fast = ema(close, 12) - ema(close, 26)
    plus, minus, adx = directional(high, low, close, 20)
    r = rsi(close)
    s = pd.Series(r)
    low14, high14 = s.rolling(14).min(), s.rolling(14).max()
    stoch = ((s - low14) / (high14 - low14).where(high14 > low14)).to_numpy()
    return {
        "rsi_14": r, "stoch_rsi": stoch, "macd": fast, "macd_signal": ema(fast, 9), "plus_di_20": plus, "minus_di_20": minus, "adx_20": adx,
        "atr_14": atr(high, low, close), "ema_3": ema(close, 3), "ema_9": ema(close, 9), "ema_21": ema(close, 21),
    }


def with_columns(bars: DataFrame, kernel, by: str = "ticker", time: str = "bar_date") -> DataFrame:
    """by, time and the kernel's columns. A group is one ticker's series; undefined values are null."""
    blank = pd.DataFrame({c: np.zeros(1) for c in ("high", "low", "close", "volume", "transactions")})
    names = list(kernel(blank))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(time, kind="stable")
        return pd.DataFrame({by: f[by].to_numpy(), time: f[time].to_numpy()} | kernel(f))

    kinds = ", ".join(f"{c} {bars.schema[c].dataType.simpleString()}" for c in (by, time))
    wanted = bars.select(by, time, "high", "low", "close", "volume", "transactions")
    out = wanted.groupBy(by).applyInPandas(run, f"{kinds}, " + ", ".join(f"{c} double" for c in names))
    from pyspark.sql import functions as F

    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})
