"""Places, running sums, chunks and sorted windows against loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import order_stats, scan


@pytest.fixture(scope="module")
def series(spark):
    """One key with most of the rows, a null key, ties of nothing, nulls and NaN."""
    rng = random.Random(1)
    rows = [("hot", t, None if rng.random() < 0.02 else round(rng.gauss(0, 3), rng.choice([0, 6])), float(t % 7)) for t in range(900)]
    rows += [(k, t, float(rng.randrange(5)), 1.0) for k in ("a", "b", None) for t in range(60)] + [("one", 0, 1.0, 2.0), ("nan", 0, float("nan"), 1.0)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "ticker string, bar_date int, x double, y double").repartition(4), sorted(rows, key=lambda r: (r[0] or "", r[1]))


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_places_and_running_sums(spark, series):
    df, rows = series
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = scan.placed(df, ["ticker"], ["bar_date"]).collect()
    assert len(got) == len(rows) and all(r["position"] == r["bar_date"] for r in got)
    plan = scan.placed(df, ["ticker"], ["bar_date"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    got = scan.running_sums(df.where("x is not null"), ["ticker"], ["bar_date"], {"sx": F.col("y"), "n": F.lit(1)}, digits=3).collect()
    want = {}
    for k, part in by_key([r for r in rows if r[2] is not None]).items():
        for r, s in zip(part, np.cumsum([r[3] for r in part]), strict=True):
            want[k, r[1]] = s
    assert len(got) == len(want) and all(float(r["sx"]) == want[r["ticker"], r["bar_date"]] for r in got)
    whole = scan.running_sums(spark.range(1000).withColumn("w", F.lit(1.5)), [], ["id"], {"s": F.col("w")}).collect()
    assert all(r["s"] == 1.5 * (r["id"] + 1) for r in whole)
    assert scan.placed(df.limit(0), ["ticker"], ["bar_date"]).count() == 0 and scan.running_sums(df.limit(0), [], ["bar_date"], {"s": F.col("y")}).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("chunk", [5, 64, 8192])
@pytest.mark.parametrize("lag,mode", [(0, "linear"), (1, "nearest"), (3, "linear")])
def test_rolling_order(series, chunk, lag, mode):
    df, rows = series
    n, qs = 12, {"lo": 0.1, "mid": 0.5, "hi": 0.97}
    got = {(r["ticker"], r["bar_date"]): r for r in order_stats.rolling_order(df, ["x", "y"], n, qs, lag=lag, mode=mode, chunk=chunk).collect()}
    assert len(got) == len(rows)
    for k, part in by_key(rows).items():
        for i, r in enumerate(part):
            for c, at in (("x", 2), ("y", 3)):
                frame = [p[at] for p in part[max(0, i - lag - n + 1) : max(0, i - lag + 1)] if p[at] is not None and p[at] == p[at]]
                for name, q in qs.items():
                    want = None if len(frame) < n else np.quantile(frame, q) if mode == "linear" else sorted(frame)[int((n - 1) * q + 0.5)]
                    have = got[k, r[1]][f"{c}_{name}"]
                    assert have == want if want is None or have is None else abs(have - want) < 1e-12


@pytest.mark.parametrize("chunk", [5, 8192])
def test_rolling_scores_equal_the_window_form(series, chunk):
    from tickloom.operators.normalize import with_rolling_z
    from tickloom.operators.windows import ordered

    df, _ = series
    df = df.where("ticker <> 'nan' or ticker is null")
    key = lambda r: (r["ticker"] or "", r["bar_date"])
    a = sorted(order_stats.rolling_scores(df, ["x", "y"], 20, chunk=chunk).collect(), key=key)
    b = sorted(with_rolling_z(df, {c: F.col(c) for c in ("x", "y")}, ordered("ticker", "bar_date"), 20).collect(), key=key)
    for r, s in zip(a, b, strict=True):
        assert key(r) == key(s)
        for c in ("x", "y"):
            assert (r[c] is None) == (s[c] is None) and (r[c] is None or abs(r[c] - s[c]) < 1e-9)


def test_sorted_window_keeps_order():
    rng = random.Random(2)
    window, held = order_stats.SortedWindow(), []
    for _ in range(2000):
        if held and rng.random() < 0.45:
            x = held.pop(rng.randrange(len(held)))
            window.drop(x)
        else:
            x = rng.choice([rng.random(), 0.5])
            held.append(x)
            window.add(x)
        assert window.values == sorted(held)
        if held:
            assert abs(window.quantile(0.3) - np.quantile(held, 0.3)) < 1e-12
    assert pd.Series(held).size == len(window)
