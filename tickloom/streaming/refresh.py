"""Rollups that are refreshed by policy: late ticks re-aggregate the buckets they touch, the newest buckets stay live.

A folder holds
- `ticks`: raw ticks, a folder for each bucket's start,
- `touched`: for each batch of ticks, the buckets it fell into (the invalidation log),
- `bars`: one bar for each (ticker, bucket), a folder for each bucket's start,
- `state`: versions of what a refresh has left to do; the newest whole one counts.

refresh() takes the log entries it has not seen and those left from before. Buckets that ended at least `end` before now are made
anew from their own ticks and their files replaced; no other file is read or written. Younger ones wait in the state for a
later refresh, buckets older than `start` are given up (and counted). A refresh that fails has changed nothing that the next
one does not do again: bars are rewritten before the state, and rewriting a bucket twice gives the same bar.
live() unites the bars with a rollup of the ticks of all younger buckets, so readers see every tick at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.rollup import rollup

LOG = "batch bigint, bucket timestamp"


@dataclass(frozen=True)
class Policy:
    interval: str = "1 hour"
    start: timedelta = timedelta(days=30)
    end: timedelta = timedelta(hours=1)


@dataclass(frozen=True)
class Refreshed:
    buckets: int
    waiting: int
    given_up: int


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _folder(bucket: str = "bucket"):
    return F.date_format(bucket, "yyyyMMddHHmm").alias("slot")


def append(batch: DataFrame, batch_id: int, folder: str, policy: Policy = Policy()) -> None:
    """Stores a batch of ticks (ticker, ts, id, price) and the buckets it touches; the same batch again replaces itself."""
    rows = batch.withColumn("bucket", F.window("ts", policy.interval)["start"])
    stored = rows.withColumn("slot", _folder()).withColumn("batch", F.lit(batch_id))
    stored.drop("bucket").repartition("slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "batch").parquet(f"{folder}/ticks")
    rows.select("bucket").distinct().coalesce(1).write.mode("overwrite").parquet(f"{folder}/touched/batch={batch_id}")


def append_stream(ticks: DataFrame, folder: str, checkpoint: str, policy: Policy = Policy()) -> StreamingQuery:
    """append() of every batch of a stream that is there."""
    return ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, k: append(batch, k, folder, policy)).trigger(availableNow=True).start()


def ticks_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/ticks").parquet(f"{folder}/ticks").drop("batch")


def _state(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    """The newest whole version, and its rows: batches that are done (bucket null) and buckets that wait (batch null)."""
    path = f"{folder}/state"
    versions = []
    if _exists(spark, path):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at):
            name = f.getPath().getName()
            if name.startswith("v") and _exists(spark, f"{path}/{name}/_SUCCESS"):
                versions.append(int(name[1:]))
    if not versions:
        return 0, spark.createDataFrame([], LOG)
    return max(versions), spark.read.schema(LOG).parquet(f"{path}/v{max(versions)}")


def refresh(spark: SparkSession, folder: str, now: datetime, policy: Policy = Policy(), fail: Callable[[], None] | None = None) -> Refreshed:
    """Makes the bars of touched buckets anew. fail: called before the state is written (tests)."""
    version, state = _state(spark, folder)
    done = state.where("bucket is null").select("batch")
    log = spark.read.schema(LOG).parquet(f"{folder}/touched")
    new = log.join(done, "batch", "left_anti")
    # a row a touched bucket of the policy's window, and younger
    touched = [r["bucket"] for r in new.select("bucket").unionByName(state.where("batch is null").select("bucket")).distinct().collect()]
    width = spark.range(1).select(F.expr(f"interval '{policy.interval.split()[0]}' {policy.interval.split()[1]}").alias("i")).first()["i"]
    old = {b for b in touched if b < now - policy.start}
    young = {b for b in touched if b + width > now - policy.end}
    ready = sorted(set(touched) - old - young)
    if ready:
        slots = [b.strftime("%Y%m%d%H%M") for b in ready]
        bars = rollup(ticks_of(spark, folder).where(F.col("slot").cast("string").isin(slots)), policy.interval)
        bars.withColumn("slot", _folder()).repartition("slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(f"{folder}/bars")
    if fail:
        fail()
    seen = new.select("batch").distinct().unionByName(done).select("batch", F.lit(None).cast("timestamp").alias("bucket"))
    waiting = spark.createDataFrame([(None, b) for b in sorted(young)], LOG)
    seen.unionByName(waiting).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/v{version + 1}")
    return Refreshed(len(ready), len(young), len(old))


def live(spark: SparkSession, folder: str, now: datetime, policy: Policy = Policy()) -> DataFrame:
    """Bars of the table, and of all younger ticks as they are. Ticks of buckets that wait for a refresh are read from their own folders only."""
    _, state = _state(spark, folder)
    waiting = [r["bucket"].strftime("%Y%m%d%H%M") for r in state.where("batch is null").select("bucket").collect()]
    done = state.where("bucket is null").select("batch")
    fresh = spark.read.schema(LOG).parquet(f"{folder}/touched").join(done, "batch", "left_anti")
    waiting += [r["bucket"].strftime("%Y%m%d%H%M") for r in fresh.where(F.col("bucket") >= F.lit(now - policy.start)).select("bucket").distinct().collect()]
    slot = F.col("slot").cast("string")
    tail = rollup(ticks_of(spark, folder).where(slot.isin(waiting)), policy.interval)
    if not _exists(spark, f"{folder}/bars"):
        return tail
    return spark.read.parquet(f"{folder}/bars").where(~slot.isin(waiting)).drop("slot").unionByName(tail)
