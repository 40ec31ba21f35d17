"""Operators that SQL cannot express, sources, sinks, streaming, and cases the tables do not hold."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import folds, indicators, joins, lifecycle, metrics, normalize, regime, simulator, windows
from tickloom.sources import bars as B
from tickloom.sources import sinks, tables


# ---- indicators against loops


def loop_ema(x, n):
    out = [math.nan] * len(x)
    if len(x) >= n:
        out[n - 1] = sum(x[:n]) / n
        for k in range(n, len(x)):
            out[k] = out[k - 1] + 2 / (n + 1) * (x[k] - out[k - 1])
    return np.array(out)


def loop_adx(h, lo, c, n):
    pdm = mdm = tr = 0.0
    dx, out = [], [math.nan] * len(c)
    for k in range(1, len(c)):
        up, down = h[k] - h[k - 1], lo[k - 1] - lo[k]
        p, m = (up if up > down and up > 0 else 0), (down if down > up and down > 0 else 0)
        t = max(h[k] - lo[k], abs(h[k] - c[k - 1]), abs(lo[k] - c[k - 1]))
        if k < n:
            pdm, mdm, tr = pdm + p, mdm + m, tr + t
            continue
        pdm, mdm, tr = pdm - pdm / n + p, mdm - mdm / n + m, tr - tr / n + t
        a, b = 100 * pdm / tr, 100 * mdm / tr
        dx.append(100 * abs(a - b) / (a + b) if a + b else 0.0)
        if len(dx) == n:
            out[k] = sum(dx) / n
        elif len(dx) > n:
            out[k] = (out[k - 1] * (n - 1) + dx[-1]) / n
    return np.array(out)


def test_recursions():
    rng = np.random.default_rng(0)
    c = 100 + rng.normal(size=300).cumsum()
    h, lo = c + rng.random(300), c - rng.random(300)
    for n in (2, 5, 20, 400):
        assert np.allclose(indicators.ema(c, n), loop_ema(c, n), equal_nan=True)
    for n in (5, 14, 60):
        assert np.allclose(indicators.directional(h, lo, c, n)[2], loop_adx(h, lo, c, n), equal_nan=True)
    r = indicators.rsi(c)
    assert np.isnan(r[:14]).all() and ((r[14:] >= 0) & (r[14:] <= 100)).all()
    assert np.allclose(indicators.rsi(np.arange(50.0))[14:], 100)


# ---- windows and joins


def test_window_edges(spark):
    rows = [("a", k, x) for k, x in enumerate([1.0, None, 3.0, 3.0, None, 6.0])] + [("b", 0, None)]
    df = spark.createDataFrame(rows, "ticker string, t int, x double")
    w = windows.ordered("ticker", "t")
    got = df.select("ticker", "t", windows.forward_filled(F.col("x"), w).alias("f"), windows.diff(F.col("x"), 1, w).alias("d"), windows.rolling("avg", F.col("x"), w, 2).alias("m"), windows.observation(F.col("x"), w, 3).alias("o")).orderBy("ticker", "t").collect()
    assert [r["f"] for r in got] == [1.0, 1.0, 3.0, 3.0, 3.0, 6.0, None]
    assert [r["d"] for r in got] == [0, 0, 0, 0, 0, 0, 0]
    assert [r["m"] for r in got] == [None, None, None, 3.0, None, None, None]
    assert got[0]["o"] == [0.0, 0.0, 1.0] and got[3]["o"] == [0.0, 3.0, 3.0]
    flat = df.select(windows.rolling_corr(F.col("x"), F.col("x") * 0, w, 2).alias("r")).collect()
    assert {r["r"] for r in flat} == {0.0}


@pytest.mark.parametrize("strict", [True, False])
def test_asof_next_against_loops(spark, strict):
    rng = random.Random(1)
    left = [(rng.randrange(4), rng.randrange(30), k) for k in range(200)]
    right = [(rng.randrange(3), rng.randrange(30), float(rng.randrange(50))) for _ in range(40)]
    got = joins.asof_next(spark.createDataFrame(left, "k int, t int, id int"), spark.createDataFrame(right, "k int, at int, v double"), ["k"], "t", "at", ["v"], strict)
    for r in got.collect():
        after = [(at, v) for k, at, v in right if k == r["k"] and (at > r["t"] if strict else at >= r["t"])]
        assert r["v"] == (min(after)[1] if after else None)
    assert got.count() == 200


def test_within_days_against_loops(spark):
    rng = random.Random(2)
    day = lambda n: pd.Timestamp("2020-01-01") + pd.Timedelta(days=n)
    a = [(rng.randrange(3), day(rng.randrange(60)).date(), i) for i in range(60)]
    b = [(rng.randrange(3), day(rng.randrange(60)).date(), i) for i in range(30)]
    got = joins.within_days(spark.createDataFrame(a, "k int, d date, i int"), spark.createDataFrame(b, "k int, e date, j int"), "k", "d", "e", 5)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((x[2], y[2]) for x in a for y in b if x[0] == y[0] and abs((x[1] - y[1]).days) <= 5)


# ---- life of a ticker


def bars_of(spark, rows):
    return spark.createDataFrame([(t, d, c, c, c, c, 10.0, 1) for t, d, c in rows], "ticker string, bar_date string, open double, high double, low double, close double, volume double, transactions int").withColumn("bar_date", F.to_date("bar_date"))


def test_split_traps(spark):
    b = bars_of(spark, [("A", "2020-01-01", 100.0), ("A", "2020-01-02", 100.0), ("A", "2020-01-03", 50.0), ("B", "2020-01-01", 5.0)])
    s = spark.createDataFrame([("A", "2020-01-02", 0.5), ("A", "2020-01-03", 0.25)], "ticker string, execution_date string, factor double").withColumn("execution_date", F.to_date("execution_date"))
    got = {(r["ticker"], str(r["bar_date"])): (r["close"], r["volume"]) for r in lifecycle.split_adjusted(b, s).collect()}
    assert got == {("A", "2020-01-01"): (50.0, 20.0), ("A", "2020-01-02"): (25.0, 40.0), ("A", "2020-01-03"): (50.0, 10.0), ("B", "2020-01-01"): (5.0, 10.0)}


def calendar_of(spark, n):
    days = spark.range(n).withColumn("bar_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")))
    return days.select("bar_date", F.col("id").alias("idx"))


@pytest.mark.parametrize("sessions,names", [((0, 1, 2, 12, 13), ["X"] * 5), ((0, 1, 2, 13, 14), ["X.1"] * 3 + ["X"] * 2)])
def test_segments_are_cut_at_ten_missed_sessions(spark, sessions, names):
    b = bars_of(spark, [("X", str(datetime.date(2024, 1, 1) + datetime.timedelta(k)), 1.0) for k in sessions])
    got = sorted((str(r["bar_date"]), r["ticker"]) for r in lifecycle.segments(b, calendar_of(spark, 30)).collect())
    assert [t for _, t in got] == names


@pytest.mark.parametrize("end,closes,volumes", [("2024-01-31", [25, 50, 50, 100, 100], [40, 20, 20, 10, 10]), ("2024-01-15", [25, 100], [40, 10])])
def test_splits_count_up_to_their_segments_end(spark, end, closes, volumes):
    """With the segment ending before the second split, that split is another company's."""
    dates = [d for d in ("2024-01-09", "2024-01-10", "2024-01-19", "2024-01-20", "2024-01-31") if d <= end] if end > "2024-01-20" else ["2024-01-09", "2024-01-15"]
    b = bars_of(spark, [("X", d, 100.0) for d in dates]).withColumns({"source_ticker": F.lit("X"), "segment": F.lit(0)})
    later = bars_of(spark, [("X", "2024-03-01", 7.0)]).withColumns({"source_ticker": F.lit("X"), "segment": F.lit(1)})
    s = spark.createDataFrame([("X", "2024-01-10", 0.25), ("X", "2024-01-20", 0.5)], "ticker string, execution_date string, factor double").withColumn("execution_date", F.to_date("execution_date"))
    got = lifecycle.segment_split_adjusted(b.unionByName(later), s).orderBy("bar_date").collect()
    assert [r["close"] for r in got] == [*closes, 7.0] and [r["volume"] for r in got] == [*volumes, 10.0]


def test_flow_with_calendar_splits_and_regime(spark):
    """A reused symbol: the split of the newer company leaves the older one alone; filled sessions carry the adjusted close."""
    from tickloom.plans.flows import daily_flow

    day = lambda k: str(datetime.date(2024, 1, 1) + datetime.timedelta(k))
    rows = [("X", day(k), 100.0 + k) for k in range(8)] + [("X", day(k), 10.0 + k) for k in range(30, 40) if k != 33]
    s = spark.createDataFrame([("X", day(35), 0.5)], "ticker string, execution_date string, factor double").withColumn("execution_date", F.to_date("execution_date"))
    regime = calendar_of(spark, 60).select("bar_date", (F.col("idx") * 2).alias("mood"))
    got = daily_flow(bars_of(spark, rows), ["volume_log"], ["volume_log"], calendar_of(spark, 60), s, regime, least_rows=2, jump=9.0, n=3)
    have = {(r["ticker"], str(r["bar_date"])): (r["close"], r["volume"], r["mood"]) for r in got.collect()}
    want = {("X.1", day(k)): (100.0 + k, 10.0, 2 * k) for k in range(8)}
    want |= {("X", day(k)): ((10.0 + k) * (0.5 if k < 35 else 1), 20.0 if k < 35 else 10.0, 2 * k) for k in range(30, 40)}
    want["X", day(33)] = (21.0, 0.0, 66)
    assert have == want


def test_gates(spark):
    b = bars_of(spark, [("A", "2020-01-01", 1.0), ("A", "2020-01-02", 3.0), ("B", "2020-01-01", 1.0), ("B", "2020-01-02", 1.2), ("C", "2020-01-01", 1.0)])
    assert {r["ticker"] for r in lifecycle.continuous(b).collect()} == {"B", "C"}
    details = spark.createDataFrame([("A", "CS"), ("B", "ETF"), ("C", "ETF")], "ticker string, type string")
    assert {r["ticker"] for r in lifecycle.tradable(b, details, ["C"]).collect()} == {"A", "C"}


def test_warm_up_and_flat_cross_section(spark):
    b = bars_of(spark, [("A", f"2020-01-{d:02d}", 5.0) for d in range(1, 20)])
    z = normalize.rolling_normalised(b, ["close"], n=5).orderBy("bar_date").collect()
    assert {r["close"] for r in z} == {0.0}
    c = normalize.cross_section(b.withColumn("sector", F.lit(1)), ["open"], sector="sector").collect()
    assert {(r["open_cs_zscore"], r["open_sector_zscore"]) for r in c} == {(0.0, 0.0)}
    assert regime.ratio_regime(b, "A", "missing", "x").count() == 0


def test_trend_states(spark):
    b = bars_of(spark, [("S", str((pd.Timestamp("2020-01-01") + pd.Timedelta(days=k)).date()), 100.0 + k + 5 * math.sin(k / 3)) for k in range(400)])
    got = regime.trend_states(b, "S").where("state is not null").collect()
    assert got and {r["state"] for r in got} <= {0, 1, 2, 3}


# ---- scalars, calendar


def test_scalar_guards(spark):
    df = spark.createDataFrame([(0.0, 0.0), (float("nan"), 1.0), (None, 2.0)], "a double, b double")
    got = df.select(S.neutralised(F.col("a")).alias("n"), S.clipped(F.col("a"), 1, 2).alias("c"), S.safe_divide(F.col("b"), F.lit(0.0)).alias("d")).collect()
    assert [r["n"] for r in got] == [0.0, 0.0, 0.0] and got[2]["c"] is None and all(r["d"] is None for r in got)
    t = spark.createDataFrame([("XLK", None), ("ABC", "7372"), ("ABC", "x"), ("ABC", "2834"), ("ABC", "")], "ticker string, sic string")
    assert [r[0] for r in t.select(S.security_sector(F.col("ticker"), F.col("sic"))).collect()] == [2, 3, 11, 4, 11]


def test_calendar(spark):
    closed = {str(d) for d in B.holidays(2024)}
    assert closed == {"2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25"}
    assert [str(d) for d in B.half_days(2024)] == ["2024-11-29", "2024-12-24", "2024-07-03"]
    days = B.sessions(spark, "2024-01-01", "2024-12-31")
    assert days.count() == 252
    minutes = B.session_minutes(days.where("bar_date in (date'2024-07-03', date'2024-07-05')"))
    assert minutes.groupBy("bar_date").count().orderBy("bar_date").collect()[0]["count"] == 210
    assert str(minutes.agg(F.min("timestamp")).first()[0]) == "2024-07-03 13:30:00"


# ---- sources and sinks


def test_flat_files_and_ingest(spark, tmp_path):
    rows = [("A", 10.5, 1.0, 2.0, 3.0, 0.5, 1_577_836_800_000_000_000, 3), ("A", 11.5, 1.0, 2.0, 3.0, 0.5, 1_577_923_200_000_000_000, 3), (None, 1.0, 1.0, 1.0, 1.0, 1.0, 1_577_836_800_000_000_000, 1)]
    spark.createDataFrame(rows, B.FLAT_SCHEMA).coalesce(1).write.option("header", True).option("compression", "gzip").csv(f"{tmp_path}/2020/01")
    bars = B.flat_bars(spark, str(tmp_path))
    assert bars.where("ticker = 'A'").agg(F.min("bar_date")).first()[0].isoformat() == "2020-01-01"
    assert B.flat_bars(spark, str(tmp_path), ["B"]).count() == 0
    path = f"{tmp_path}/table"
    assert sinks.ingest(spark, bars, path, F.col("volume")) == 1
    assert sinks.ingest(spark, bars.withColumn("volume", F.col("volume") + 100), path, F.col("volume")) == 1
    assert sorted(r["volume"] for r in spark.read.parquet(path).collect()) == [10, 12]  # half to even, first arrival stays
    assert B.columns_of(spark, path)[0] == "ticker"
    names = spark.createDataFrame([("run_3_x",), ("run_12",), ("other",)], "name string")
    assert sinks.next_run_number(names) == 13 and sinks.next_run_number(names.limit(0)) == 1


def test_compaction_of_old_dates(spark, tmp_path):
    path = f"{tmp_path}/table"
    for k in range(3):
        rows = spark.sql(f"SELECT concat('T', id % 3) ticker, timestamp'2020-01-01' + make_interval(0, 0, 0, id % 2, 0, {k}, id) timestamp, to_date('2020-01-01') + cast(id % 2 as int) bar_date, id v FROM range(12)")
        sinks.append_bars(rows, path)
    before = sorted(map(tuple, spark.read.parquet(path).collect()), key=repr)
    sinks.compact(spark, path, "2020-01-02")
    old, new = (sorted((tmp_path / "table" / f"bar_date=2020-01-0{d}").glob("*.parquet")) for d in (1, 2))
    assert (len(old), len(new)) == (1, 3)
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=repr) == before
    got = [(r["ticker"], -r["timestamp"].timestamp()) for r in spark.read.parquet(str(old[0])).collect()]
    assert got == sorted(got)


def test_json_bars_and_side_tables(spark, tmp_path):
    (tmp_path / "ABC.json").write_text('[{"timestamp": 1577836800000, "open": 1, "high": 2, "low": 1, "close": 2, "transactions": 1, "volume": 5, "vwap": 1.5}]')
    r = B.json_bars(spark, f"{tmp_path}/ABC.json").first()
    assert r["ticker"] == "ABC" and str(r["timestamp"]) == "2020-01-01 00:00:00"
    cache = spark.createDataFrame([("A", 2.0, 0.0)], "ticker string, split_to double, split_from double")
    got = B.extended(cache, cache.limit(0), spark.createDataFrame([("A",), ("B",)], "ticker string"), ["ticker"], F.col("split_to"))
    assert {r["ticker"]: r["split_to"] for r in got.collect()} == {"A": 2.0, "B": None}
    assert B.with_effective_ratio(cache).first()["effective_ratio"] is None
    groups = spark.createDataFrame([("g", "A"), ("g", "Z"), ("h", "Z")], "group string, ticker string")
    assert [r["group"] for r in B.missing_any_of(groups, cache).collect()] == ["h"]


def test_streamed_rollups_equal_batch(spark, data, tmp_path):
    from tickloom.operators.rollup import rollup
    from tickloom.streaming.rollups import streamed_rollup, tick_stream, upserted

    t = tables.ticks(spark, data).select("ticker", "ts", "id", "price").withColumn("ts", F.col("ts").cast("timestamp"))
    t.repartition(5).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        upserted(streamed_rollup(tick_stream(spark, f"{tmp_path}/in", t.schema, 2), "1 hour"), f"{tmp_path}/bars", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/bars").drop("day")
    want = rollup(t, "1 hour")
    assert got.count() == want.count() and got.select(want.columns).exceptAll(want).count() == 0


# ---- simulator, folds


def test_simulator_invariants(spark):
    rng = random.Random(3)
    rows = [(e, k, [10 + rng.random(), 20 + rng.random()], [rng.uniform(-2, 2), rng.uniform(-2, 2)]) for e in range(4) for k in range(30)]
    steps = spark.createDataFrame(rows, "episode int, step bigint, prices array<double>, actions array<double>")
    got = simulator.simulate(steps).orderBy("episode", "step").collect()
    for r, (_, k, p, _) in zip(got, rows, strict=True):
        assert abs(r["pv"] - r["cash"] - sum(a * b for a, b in zip(r["shares"], p, strict=True))) < 1e-6 and r["cash"] >= -1e-6 and abs(r["reward"]) <= 10
        assert k < 29 or r["shares"] == [0.0, 0.0]
    free = simulator.simulate(steps, simulator.Costs(spread=0, slippage=0)).groupBy("episode").agg(F.max("fees").alias("f")).collect()
    assert all(r["f"] > 0 for r in free)
    cash, shares = simulator.target_position((1000.0, 0.0), 10.0, 0.5, simulator.Costs(spread=0, slippage=0))
    assert abs(shares - 50) < 1e-9 and abs(cash - 500) < 0.01
    assert simulator.target_position((1000.0, 0.0), 10.0, 0.05, simulator.Costs()) == (1000.0, 0.0)  # within the deadband
    assert simulator.delta_action((100.0, 3.0), 10.0, -9, simulator.Costs())[1] == 0.0


def test_degenerate_metrics(spark):
    flat = spark.createDataFrame([("c", k, 100.0) for k in range(5)], "curve string, step int, pv double")
    r = metrics.performance(flat).first()
    assert r["total_return"] == 0 and r["sharpe"] is None and r["profit_factor"] is None and r["max_drawdown"] == 0


def test_pools_over_tickers_need_no_window_over_all(spark):
    """Episodes of every ticker, ages over the whole pool; no plan brings a pool or series into one task."""
    rows = [(t, str(datetime.date(2020, 1, 1) + datetime.timedelta(k))) for t, n in (("hot", 90), ("a", 12), ("short", 4)) for k in range(n)]
    dates = spark.createDataFrame(rows, "ticker string, bar_date string").withColumn("bar_date", F.to_date("bar_date")).repartition(3)
    pool = folds.episode_pool(dates, 5, 2.0, 2, "ticker")
    got = sorted((str(r["start_date"]), r["ticker"], str(r["end_date"]), r["start_idx"], r["age"], r["weight"]) for r in pool.collect())
    starts = sorted((rows[i][1], t, k) for i, (t, k) in enumerate((t, k) for t, n in (("hot", 90), ("a", 12), ("short", 4)) for k in range(n)) if k % 2 == 0 and k + 4 < {"hot": 90, "a": 12, "short": 4}[t])
    ages = [1 - i / (len(starts) - 1) for i in range(len(starts))]
    total = sum(math.exp(-2 * x) for x in ages)
    assert len(got) == len(starts)
    for g, (d, t, k), x in zip(got, starts, ages, strict=True):
        assert g[:2] == (d, t) and g[3] == k and g[2] == str(datetime.date.fromisoformat(d) + datetime.timedelta(4))
        assert abs(g[4] - x) < 1e-12 and abs(g[5] - math.exp(-2 * x) / total) < 1e-12
    assert folds.drawn(pool, 300, 5, ["start_date", "ticker"]).count() == 300
    for df in (pool, folds.drawn(pool, 300, 5, ["start_date", "ticker"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any("Window [" in line and "], [" not in line for line in plan.splitlines())


def test_draws(spark):
    dates = spark.range(300).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("bar_date"))
    pool = folds.episode_pool(dates, 50, 3.0)
    assert pool.count() == 251 and abs(pool.agg(F.sum("weight")).first()[0] - 1) < 1e-9
    a, b = folds.drawn(pool, 500, 1).orderBy("draw").collect(), folds.drawn(pool.repartition(7), 500, 1).orderBy("draw").collect()
    assert [r["start_idx"] for r in a] == [r["start_idx"] for r in b] and [r["draw"] for r in a] == list(range(500))
    rows = pool.orderBy("start_idx").collect()
    upto = np.cumsum([r["weight"] for r in rows])
    u = [r["u"] for r in spark.range(500).select(folds.uniform(1, "id").alias("u")).collect()]
    assert [r["start_idx"] for r in a] == [rows[min(int(np.searchsorted(upto / upto[-1], x, "right")), len(rows) - 1)]["start_idx"] for x in u]
    assert folds.drawn(pool.limit(0), 10, 1).count() == 0 and folds.episode_pool(dates.limit(0), 50).count() == 0
    assert np.mean([r["start_idx"] for r in a]) > 150
    assert folds.validation_set(pool, 10, 1).distinct().count() == 10
    sample = folds.recency_sample(spark, 100, 20, 128, 1000, 4.0, 2).collect()
    assert {r["slot"] for r in sample} <= {(19 - k) % 128 for k in range(100)}


def test_weight_statistics_count_unnamed_assets_as_zero(spark):
    from tickloom.operators.metrics import weight_statistics

    rows = [(1, 1, "a", 0.25), (1, 1, "a", 0.25), (1, 1, "b", 0.5), (1, 2, "a", 1.0), (1, 3, "b", 0.4), (2, 1, "a", 0.3)]
    got = {(r["e"], r["asset"]): r for r in weight_statistics(spark.createDataFrame(rows, "e int, step int, asset string, weight double"), ["e"]).collect()}
    want = {(1, "a"): [0.5, 1.0, 0.0], (1, "b"): [0.5, 0.0, 0.4], (1, "cash"): [0.0, 0.0, 0.6], (2, "a"): [0.3], (2, "cash"): [0.7]}
    assert set(got) == set(want)
    for k, values in want.items():
        assert np.allclose([got[k][c] for c in ("mean", "std", "least", "most")], [np.mean(values), np.std(values), min(values), max(values)], atol=1e-12)


def test_json_bars_of_folders(spark, tmp_path):
    bars = spark.sql("SELECT * FROM VALUES ('A/B', timestamp'2020-01-01', 1.5D), ('A/B', timestamp'2021-01-01', 2.5D), ('A+ %', timestamp'2021-01-01', 4D), ('C', timestamp'2020-01-01', 3.5D) t(ticker, timestamp, close)")
    sinks.write_json_bars(bars, f"{tmp_path}/j")
    got = sorted((r["ticker"], str(r["timestamp"]), r["close"]) for r in B.json_bars(spark, f"{tmp_path}/j").collect())
    assert got == [("A+ %", "2021-01-01 00:00:00", 4.0), ("A/B", "2020-01-01 00:00:00", 1.5), ("A/B", "2021-01-01 00:00:00", 2.5), ("C", "2020-01-01 00:00:00", 3.5)]


def test_fetch_binds_arguments(spark):
    spark.range(5).createOrReplaceTempView("some_ids")
    text = "SELECT id FROM IDENTIFIER(:name) WHERE id > :least"
    assert [r["id"] for r in sinks.fetch(spark, text, name="some_ids", least=2).collect()] == [3, 4]
    assert sinks.fetch(spark, "SELECT :v AS v", v="1; DROP TABLE some_ids").first()["v"] == "1; DROP TABLE some_ids"


def test_column_statistics_of_nulls(spark, tmp_path):
    sinks.create_schemas(spark, ("staging",))
    name = f"staging.t_{tmp_path.name}"
    sinks.load_table(spark.createDataFrame([(1, None), (5, "x"), (None, "y")], "a int, s string"), name, f"{tmp_path}/t", {"spark__sql__parquet__compression__codec": "gzip"})
    got = {r["name"]: r for r in sinks.column_statistics(spark, name).collect()}
    assert (got["a"]["least"], got["a"]["most"], got["a"]["n_nulls"], got["s"]["n_nulls"]) == ("1", "5", 1, 1)
    assert spark.conf.get("spark.sql.parquet.compression.codec") != "gzip"
