"""What the findings of the third round were about."""

import math
from functools import reduce

import numpy as np
from pyspark.sql import functions as F


def test_rounding_leaves_infinity_and_large_values(spark):
    """episode_summaries: a product beyond doubles is infinite, as in its SQL, and not the largest bigint."""
    from tickloom.operators.metrics import episode_summary
    from tickloom.plans.registry import rounded

    values = [math.inf, -math.inf, 1e300, -1e18, 1.2345674, -1.2345676, None]
    got = [r["y"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").withColumn("y", rounded(F.col("x"))).orderBy("i").collect()]
    assert got[:4] == [math.inf, -math.inf, 1e300, -1e18] and np.allclose(got[4:6], [1.234567, -1.234568], atol=1e-12) and got[6] is None
    assert math.isnan(spark.range(1).select(rounded(F.lit(float("nan"))).alias("y")).first()["y"])
    up, down = (spark.range(n).select(F.lit(0).alias("m"), F.col("id").alias("episode"), F.lit(r).alias("ret"), F.lit(0.0).alias("benchmark")) for n, r in ((2000, 0.5), (200, -0.5)))
    assert episode_summary(up, ["m"]).select(rounded(F.col("log_growth")).alias("g")).first()["g"] == math.inf
    assert abs(episode_summary(down, ["m"]).first()["log_growth"] - 200 * math.log(0.5)) < 1e-9


def test_short_series_take_one_pass(spark, monkeypatch):
    """F3, F6 to F8, F11: series that a task can hold are neither placed nor called one by one."""
    from tickloom.operators import features, order_stats, recursions, regime, scan

    def unwanted(*_, **__):
        raise AssertionError("short series are not cut")

    for module in (scan, recursions):
        monkeypatch.setattr(module, "placed", unwanted)
    df = spark.range(4000).selectExpr("cast(id % 40 AS string) AS ticker", "cast(id div 40 AS int) AS bar_date", "10 + id * 37 % 101 AS close", "111.0 + id % 7 AS high", "9.0 AS low", "5.0 AS volume", "2 AS transactions")
    plans = [features.with_volatility(df, pairs=((5, 20),)), order_stats.rolling_scores(df, ["close"], 20), regime.breadth(df, "close", (5, 20)), recursions.trend(df), recursions.classic(df)]
    for got in plans:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan
    assert [p.count() for p in plans] == [4000, 4000, 100, 4000, 4000]


def test_sliding_statistics_equal_loops():
    from tickloom.operators import sliding

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(1e6, 1, 300), np.full(80, 0.1), [np.nan], rng.integers(0, 4, 200).astype(float)])
    for n in (1, 2, 5, 13, 60, 252):
        mean, m2 = sliding.moments(x, n)
        least, sums = sliding.smallest(x, n, 4), sliding.ordered_sums(x, n)
        for i in range(n - 1, len(x)):
            frame = x[i - n + 1 : i + 1]
            if np.isnan(frame).any():
                assert np.isnan(mean[i]) and np.isnan(m2[i]) and np.isnan(sums[i])
                continue
            assert np.allclose([mean[i], m2[i]], [frame.mean(), frame.var() * n], rtol=1e-9, atol=1e-7)
            assert (frame.min() < frame.max()) or m2[i] == 0
            want = np.sort(frame)[:4].tolist()
            assert [v[i] for v in least][: len(want)] == want and sums[i] == reduce(lambda a, b: a + b, frame.tolist(), 0.0)


def test_volatility_of_long_and_short_series(spark):
    """equal to a loop, with nulls, in chunks and whole."""
    from tickloom.operators.features import with_volatility

    rng = np.random.default_rng(6)
    rows = [(k, t, None if rng.random() < 0.01 else float(rng.integers(1, 5)) if k == "a" else 7.0) for k, n in (("a", 300), ("b", 30), (None, 50)) for t in range(n)]
    df = spark.createDataFrame(rows, "ticker string, bar_date int, close double").repartition(3)
    for chunk in (40, 8192):
        got = {(r["ticker"], r["bar_date"]): r for r in with_volatility(df, pairs=((5, 20),), alone=15, chunk=chunk).collect()}
        assert len(got) == len(rows)
        for i, (k, t, _) in enumerate(rows):
            frame = lambda n: [r[2] for r in rows[i - min(n - 1, t) : i + 1] if r[2] is not None]  # noqa: B023, E731
            sd = {n: np.std(frame(n)) if len(frame(n)) == n else None for n in (5, 15, 20)}
            r = got[k, t]
            for have, want in ((r["volatility_15"], None if sd[15] is None else np.log1p(sd[15])), (r["volatility_5_20_ratio"], None if None in (sd[5], sd[20]) else np.log((sd[5] + 1e-8) / (sd[20] + 1e-8)))):
                assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-6)


def _many_tickers(spark, n=900):
    return spark.range(n * 2).selectExpr("cast(id div 2 AS string) AS ticker", "timestamp'2020-01-01' + make_interval(id % 2) AS timestamp", "id / 2.0D AS close")


def test_json_bars_of_many_tickers_are_few_files(spark, tmp_path):
    """files follow the data, not the tickers; bars of a folder's or a file's ticker are read as before."""
    from tickloom.sources import bars, sinks

    rows = _many_tickers(spark)
    sinks.write_json_bars(rows, f"{tmp_path}/j")
    assert len([p for p in (tmp_path / "j").rglob("*") if p.suffix != ".crc"]) < 50
    for lines in (True, None):
        got = bars.json_bars(spark, f"{tmp_path}/j", lines).select("ticker", "timestamp", "close")
        assert got.exceptAll(rows).count() == 0 and got.count() == 1800
    assert bars.json_bars(spark, f"{tmp_path}/j", False).count() == 0
    (tmp_path / "j" / "ticker=A%252FB").mkdir()
    (tmp_path / "j" / "ticker=A%252FB" / "x.json").write_text('[{"timestamp": 0, "close": 1},\n {"timestamp": 1, "close": 2}]')
    assert {r["ticker"] for r in bars.json_bars(spark, f"{tmp_path}/j", False).collect()} <= {"A/B", "A%2FB"}
    assert bars.json_bars(spark, f"{tmp_path}/j").count() == 1802


def test_ticker_folders_do_not_grow_with_tickers(spark, tmp_path):
    """at most `folders` folders and files, and a ticker's folder alone is read."""
    from tickloom.sources import sinks

    rows = _many_tickers(spark).unionByName(spark.sql("SELECT CAST(NULL AS string) AS ticker, timestamp'2020-01-01' AS timestamp, 5D AS close"))
    sinks.write_features(rows, f"{tmp_path}/f", folders=16)
    assert len(list((tmp_path / "f").rglob("*.parquet"))) <= 16
    read = lambda tickers=None: sinks.read_features(spark, f"{tmp_path}/f", "ticker string, timestamp timestamp, close double", tickers, folders=16)
    assert read().exceptAll(rows).count() == 0 and read().count() == 1801
    got = read(["3", "7", "none"])
    assert sorted(r["close"] for r in got.collect()) == [3.0, 3.5, 7.0, 7.5] and len(got.inputFiles()) <= 3


def test_requests_share_partitions():
    """tasks grow with the requests only up to a bound each, and none is lost or out of order."""
    from tickloom.sources import vendor

    for n in (0, 1, 64, 129, 5000, 60_000):
        parts = [p.value for p in vendor.dealt(list(range(n)))]
        assert [r for p in parts for r in p] == list(range(n)) and all(len(p) <= vendor.REQUESTS for p in parts)
        assert len(parts) <= max(3 * vendor.SIDE_BY_SIDE, n // vendor.REQUESTS + 1)


def test_only_renamed_tickers_are_sorted(spark, data):
    """bars without a rename go through no window and no sort."""
    import __spark_entry__ as entry
    from tickloom.operators.lifecycle import stitched

    bars = spark.sql("SELECT * FROM VALUES ('A', DATE'2020-01-01', 1), ('A', DATE'2020-01-03', 2), ('B', DATE'2020-01-02', 3), ('B', DATE'2020-01-03', 4), ('C', DATE'2020-01-01', 5) t(ticker, bar_date, close)")
    renames = spark.sql("SELECT 'A' AS current_ticker, 'B' AS previous_ticker, DATE'2020-01-03' AS change_date")
    got = sorted((r["ticker"], str(r["bar_date"])[-2:], r["close"]) for r in stitched(bars, renames).collect())
    assert got == [("A", "02", 3), ("A", "03", 2), ("B", "02", 3), ("B", "03", 4), ("C", "01", 5)]
    plan = entry.queries()["stitched_tickers"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and plan.count("Union") == 2
