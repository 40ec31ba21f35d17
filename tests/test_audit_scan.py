"""Blocked correlations and the one-scan audit against plain loops, with nulls, NaN, long tickers over many ranges and flat columns."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import audit, audit_scan, gram, lifecycle


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    n = 700
    base = rng.normal(size=n)
    cols = {f"c{k}": base * (k % 3) + rng.normal(size=n) * (0.1 + k) + 1e6 * (k == 4) for k in range(7)} | {"flat": np.full(n, 3.0), "gone": np.full(n, np.nan)}
    frame = pd.DataFrame(cols)
    for c in list(frame)[:5]:
        frame.loc[rng.random(n) < 0.1, c] = np.nan
    frame.insert(0, "ticker", [None if x < 0.05 else "hot" if x < 0.8 else rng.choice(list("ab")) for x in rng.random(n)])
    df = spark.createDataFrame([tuple(None if isinstance(v, float) and v != v else v for v in r) for r in frame.itertuples(index=False)], "ticker string, " + ", ".join(f"{c} double" for c in list(frame)[1:]))
    return df.repartition(5), frame


@pytest.mark.parametrize("width,cells", [(64, 1 << 21), (2, 8)])
@pytest.mark.parametrize("by,complete", [(None, False), (["ticker"], False), (None, True)])
def test_correlations(table, width, cells, by, complete):
    df, frame = table
    columns = [c for c in frame.columns if c != "ticker"]
    columns = [c for c in columns if c != "gone"] if complete else columns
    got = {(*[r[c] for c in by or []], r["a"], r["b"]): r for r in gram.correlations(df, columns, by, complete, width, cells).collect()}
    groups = [((), frame)] if not by else [((None if k != k else k,), g) for k, g in frame.groupby("ticker", dropna=False)]
    count = 0
    for key, g in groups:
        g = g.dropna(subset=columns) if complete else g
        for i, a in enumerate(sorted(columns)):
            for b in sorted(columns)[i + 1 :]:
                both = g[[a, b]].dropna()
                want = both[a].corr(both[b]) if len(both) > 1 and both[a].std() > 0 and both[b].std() > 0 else None
                have = got[(*key, a, b)]
                count += 1
                assert have["n"] == len(both) and (have["r"] is None) == (want is None), (key, a, b, have, want)
                assert want is None or abs(have["r"] - want) < 1e-9
    assert count == len(got)


def test_regime_collinear(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=150)
    rows = [(float(v), float(-v + e), float(z), None if k < 20 else float(v)) for k, (v, e, z) in enumerate(zip(x, 0.05 * rng.normal(size=150), rng.normal(size=150), strict=True))]
    df = spark.createDataFrame(rows, "x double, y double, z double, late double")
    got = gram.regime_collinear(df, ["z", "y", "x", "late"]).collect()
    assert [(r["a"], r["b"]) for r in got] == [("late", "x"), ("late", "y"), ("x", "y")] and got[1]["r"] < -0.9
    assert gram.regime_collinear(df.limit(110), ["z", "y", "x", "late"]).count() == 0  # 90 complete rows


def test_audit_scan_equals_the_checks(spark):
    rng = random.Random(3)
    day = datetime.date(2001, 1, 1)
    rows = []
    for t, n in (("hot", 3000), ("gaps", 400), ("short", 3), ("all null", 5), (None, 40), ("gone", 50)):
        close = 10.0
        for k in range(n):
            close *= rng.choice([1, 1.01, 0.99, 1.6 if rng.random() < 0.02 else 1, 0.45 if rng.random() < 0.01 else 1])
            close = min(max(close, 1e-3), 1e6)
            c = None if t == "all null" or t == "gaps" and (k < 7 or k > 380 or k % 50 == 0) else close
            rows.append((t, day + datetime.timedelta(k), c, None if c is None else c * 1.0001, rng.choice([0.5, 2.0, None, float("nan"), float("inf")]) if rng.random() < 0.05 else float(rng.randrange(4)), 0.25))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "ticker string, bar_date date, close double, high double, x double, flat double").repartition(6)
    columns = ["x", "close", "high", "flat"]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    got = {(r["check"], r["subject"], r["severity"]): r["value"] for r in audit_scan.audit(df, columns).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for r in audit.missing_and_invalid(df, columns).collect():
        if r["n_null"] + r["n_nan"] + r["n_inf"]:
            want["missing", r["feature"], "warning"] = r["n_null"] + r["n_nan"] + r["n_inf"]
    for r in audit.close_nulls(df).where("interior > 0").collect():
        want["interior nulls", r["ticker"], "critical"] = r["interior"]
    for r in audit.survivorship(df).where("not active").collect():
        want["delisted", r["ticker"], "info"] = 1
    for r in lifecycle.discontinuities(df).groupBy("ticker", "severity").count().collect():
        want["discontinuity", r["ticker"], r["severity"]] = r["count"]
    finite = df.withColumn("x", audit.F.when(audit.F.abs("x") < float("inf"), audit.F.col("x")))
    for r in audit.multicollinear(finite, columns).where("n_high > 0").collect():
        want["collinear", f"{r['a']}|{r['b']}", "info"] = r["n_high"]
    for r in audit.downcastable(finite, columns).where("fits").collect():
        want["downcast", r["feature"], "info"] = r["loss"]
    for r in audit.yearly_drift(finite, columns).where("drifted").groupBy("feature").count().where("count >= 2").collect():
        want["drift", r["feature"], "warning"] = r["count"]
    values = [r[4] for r in rows if r[4] is not None]
    want["saturation", "x", "info"] = sum(abs(v) > 0.99 for v in values) / len(values)
    for k, c in ((2, "close"), (3, "high")):
        values = [r[k] for r in rows if r[k] is not None]
        want["saturation", c, "info"] = sum(abs(v) > 0.99 for v in values) / len(values)
    assert set(got) == set(want), set(got) ^ set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
