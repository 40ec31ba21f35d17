"""Streaming OHLCV rollups: event-time buckets with late data, kept up to date in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.rollup import ohlcv

LATE = "30 days"


def tick_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Ticks from Parquet files as they arrive; ts as an event time."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def streamed_rollup(ticks: DataFrame, interval: str, late: str = LATE, price: str = "price") -> DataFrame:
    """Bars per (ticker, bucket); a bucket changes while ticks are up to `late` behind."""
    got = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", interval).alias("w")).agg(*ohlcv(price))
    return got.select("ticker", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume")


def upserted(bars: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps a Parquet table of bars, partitioned by day, up to date: the days a batch touches are rewritten.

    Rewriting is idempotent, so a batch that runs again after a failure leaves the same table. Hourly trigger unless once.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("day", F.to_date("bucket")).persist()
        days = [r["day"] for r in new.select("day").distinct().collect()]  # at most the days of one batch
        if days:
            try:
                old = spark.read.parquet(path).where(F.col("day").isin(days))
            except Exception as e:  # the first batch finds no table
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                old = new.limit(0)
            kept = old.join(new.select("ticker", "bucket"), ["ticker", "bucket"], "left_anti").select(new.columns)
            staged = f"{path}_staged/{batch_id}"
            kept.unionByName(new).write.mode("overwrite").parquet(staged)
            spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        new.unpersist()

    writer = bars.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 hour")).start()
