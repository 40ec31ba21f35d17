"""Refreshes by policy: which files change, what waits, what is given up, and what readers see."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest

from tickloom.operators.rollup import rollup
from tickloom.streaming import refresh as R

SCHEMA = "ticker string, ts timestamp, id bigint, price double"


def at(day, hour, minute=0):
    return datetime(2024, 3, day, hour, minute)


def files(folder):
    return {p: p.stat().st_mtime_ns for p in Path(folder, "bars").rglob("part-*.parquet")}


def bars(df):
    return sorted((r["ticker"], r["bucket"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in df.collect())


def test_late_ticks_rewrite_their_buckets_only(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(f"T{k % 2}", at(1 + k // 20, k % 20, k % 60), k, float(k * 13 % 17)) for k in range(60)]  # three days of 20 hours
    now = at(3, 20, 30)
    R.append(spark.createDataFrame(rows, SCHEMA), 0, folder)
    got = R.refresh(spark, folder, now)
    assert (got.buckets, got.waiting, got.given_up) == (59, 1, 0)  # the hour that ended half an hour ago waits
    before = files(folder)
    assert bars(R.live(spark, folder, now)) == bars(rollup(spark.createDataFrame(rows, SCHEMA), "1 hour"))

    late = [("T0", at(1, 5, 59), 100, 99.0), ("T9", at(2, 7, 1), 101, 1.0), ("T0", at(1, 5, 0), 102, -1.0)]
    R.append(spark.createDataFrame(late, SCHEMA), 1, folder)
    want = bars(rollup(spark.createDataFrame(rows + late, SCHEMA), "1 hour"))
    assert bars(R.live(spark, folder, now)) == want  # seen before any refresh
    got = R.refresh(spark, folder, now)
    assert (got.buckets, got.waiting) == (2, 1)
    after = files(folder)
    changed = {p.parent.name for p in set(before) ^ set(after)}
    assert changed == {"slot=202403010500", "slot=202403020700"} and all(after[p] == before[p] for p in set(before) & set(after))
    assert bars(R.live(spark, folder, now)) == want
    assert R.refresh(spark, folder, now).buckets == 0 and files(folder) == after
    assert R.refresh(spark, folder, now + timedelta(hours=1)).buckets == 1 and bars(R.live(spark, folder, now)) == want


def test_ticks_beyond_the_start_offset_are_given_up(spark, tmp_path):
    folder = str(tmp_path)
    R.append(spark.createDataFrame([("A", at(1, 1), 1, 1.0), ("A", at(20, 1), 2, 2.0)], SCHEMA), 0, folder)
    got = R.refresh(spark, folder, at(20, 1) + timedelta(days=25))
    assert (got.buckets, got.waiting, got.given_up) == (1, 0, 1)
    assert [b[1] for b in bars(R.live(spark, folder, at(20, 1) + timedelta(days=25)))] == [at(20, 1)]


def test_a_refresh_or_batch_that_fails_is_done_again(spark, tmp_path):
    folder = str(tmp_path)
    rows = [("A", at(1, k), k, float(k)) for k in range(10)]
    R.append(spark.createDataFrame(rows, SCHEMA), 0, folder)

    def fail():
        raise ValueError("lost")

    with pytest.raises(ValueError, match="lost"):
        R.refresh(spark, folder, at(2, 0), fail=fail)
    R.append(spark.createDataFrame(rows, SCHEMA), 0, folder)  # the same batch comes again
    assert R.refresh(spark, folder, at(2, 0)).buckets == 10
    assert bars(R.live(spark, folder, at(2, 0))) == bars(rollup(spark.createDataFrame(rows, SCHEMA), "1 hour"))
