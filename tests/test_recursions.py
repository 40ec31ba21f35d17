"""Scans of recursive averages against loops over whole series, in chunks of any size."""

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import indicators, recursions, scan


def bars(spark, n, tickers=("hot",), seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k, t in enumerate(tickers):
        m = n if k == 0 else 30 * k
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, m)))
        high, low = close * (1 + rng.random(m) * 0.01), close * (1 - rng.random(m) * 0.01)
        flat = rng.random(m) < 0.05
        high[flat] = low[flat] = close[flat]
        rows.append(pd.DataFrame({"ticker": t, "bar_date": np.arange(m), "high": high, "low": low, "close": close, "volume": rng.integers(0, 1000, m).astype(float), "transactions": rng.integers(0, 50, m)}))
    frame = pd.concat(rows)
    return spark.createDataFrame(frame.sample(frac=1, random_state=2)).repartition(5), frame


@pytest.mark.parametrize("chunk", [7, 100, 8192])
@pytest.mark.parametrize("kind", ["trend", "classic"])
def test_indicators_equal_the_loops(spark, kind, chunk):
    df, frame = bars(spark, 400, ("hot", "a", "b"))
    scanned, kernel = (recursions.trend, indicators.trend_columns) if kind == "trend" else (recursions.classic, indicators.classic_columns)
    got = scanned(df, chunk=chunk).toPandas().sort_values(["ticker", "bar_date"]).reset_index(drop=True)
    want = pd.concat([pd.DataFrame({"ticker": t, "bar_date": f["bar_date"]} | kernel(f)) for t, f in frame.groupby("ticker")]).reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for c in want.columns[2:]:
        a, b = got[c].to_numpy(float), want[c].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all(), c
        assert np.nanmax(np.abs(a - b), initial=0) < 1e-7, c


@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_averages_with_gaps_and_late_starts(spark, chunk):
    rng = np.random.default_rng(3)
    x = rng.normal(size=120)
    x[:9] = np.nan
    x[rng.random(120) < 0.2] = np.nan
    rows = [("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [("none", i, None) for i in range(10)] + [("few", i, 1.0) for i in range(3)] + [(None, i, float(i)) for i in range(12)]
    df = scan.placed(spark.createDataFrame(rows, "ticker string, t int, x double"), ["ticker"], ["t"])
    averages = {"e": recursions.ema("x", 5), "w": recursions.wilder_sum("x", 5)}
    got = {(r["ticker"], r["t"]): r for r in recursions.averaged(df, averages, ["ticker"], chunk=chunk).collect()}
    assert len(got) == len(rows)
    for t in ("a", "none", "few", None):
        e = w = None
        seen, total = 0, 0.0
        for _, i, v in (r for r in rows if r[0] == t):
            late = False
            if v is not None:
                seen, total = seen + 1, total + v
                e = total / 5 if seen == 5 else None if seen < 5 else 2 / 3 * e + v / 3
                late = seen == 4
                w = total if seen == 4 else None if seen < 4 else w - w / 5 + v
                shown = seen > 4
            else:
                shown = seen > 4
            for name, value in (("e", e), ("w", w if shown and not late else None)):
                have = got[t, i][name]
                assert (have is None) == (value is None) and (value is None or abs(have - value) < 1e-12), (t, i, name)


def test_a_long_series_is_many_tasks(spark):
    """One ticker of 300,000 bars in chunks of 8192: equal to one pass over all of it."""
    df, frame = bars(spark, 300_000)
    rows = scan.placed(df, ["ticker"], ["bar_date"])
    got = recursions.averaged(rows, {"e": recursions.ema("close", 252)}, ["ticker"]).select("bar_date", "e").toPandas().sort_values("bar_date")
    want = indicators.ema(frame["close"].to_numpy(), 252)
    assert np.nanmax(np.abs(got["e"].to_numpy() / want - 1)) < 1e-9 and np.isnan(got["e"]).sum() == 251
