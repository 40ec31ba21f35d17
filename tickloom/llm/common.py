"""What the operators share: reading tables, the shared folder, connected components."""

from __future__ import annotations

import ctypes
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as session.shared_folder() finds it; checkpoints go there, too."""
    path = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows for the session, unless it has set another size than Spark's default.

    Rows here hold whole texts, so ten thousand of them would take too much of a worker's memory.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def give_back() -> None:
    """Returns freed memory of a Python worker to the system, where its C library can do that.

    Workers live on between tasks; without this each keeps the most it ever held.
    """
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._written_to = path
    return got


class Scratch:
    """Tables in the shared folder that are deleted when nothing reads them any more."""

    def __init__(self):
        self.held: dict[int, DataFrame] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return self.keep(written(df, name))

    def keep(self, got: DataFrame) -> DataFrame:
        """got: from written()."""
        self.held[id(got)] = got
        return got

    def drop(self, *tables: DataFrame) -> None:
        for table in list(tables):
            if self.held.pop(id(table), None) is not None:
                removed(table.sparkSession, table._written_to)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one file to any store that Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    for low in range(0, len(data), 1 << 20):
        out.write(data[low : low + (1 << 20)])
    out.close()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


ID_BUCKETS = 1 << 20


def touching(docs: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """The rows of docs whose keys (doc_id) may be in ids: those that share a hash bucket with one.

    The broadcast holds at most ID_BUCKETS numbers; with more ids than buckets it lets every row pass.
    """
    bucket = F.pmod(F.xxhash64(*(keys or ("doc_id",))), F.lit(ID_BUCKETS))
    return docs.withColumn("__bucket", bucket).join(F.broadcast(ids.select(bucket.alias("__bucket")).distinct()), "__bucket", "left_semi").drop("__bucket")


HOT_SHARE = 200
FEW_NODES = 20_000


def connected_components(edges: DataFrame, few: int = FEW_NODES) -> DataFrame:
    """(node, component): component is the smallest node reachable. edges: (a, b) longs, any direction, repeats allowed.

    In a round each node takes the least label of its neighbours, and so does the node that its old label names
    (hooking); then each label is replaced by its own label (pointer jumping). Labels only fall, and the rounds end when
    none does, without a cap. Chains of 500 to 500,000 nodes, with ids in order and shuffled, took 8 to 20 rounds in a
    simulation of this rule. Nodes without an edge are not in the result.
    Tables of one row a node are broadcast while there are at most `few` nodes (two longs each, under 1 MB), so a round deals
    rows out twice only and no task gathers a component. With more nodes all joins shuffle, and labels that more than one node
    in HOT_SHARE has, at most that many, are looked up by a broadcast of their rows. Each round is checkpointed; nothing but a
    count and those labels reaches the driver in a round.
    """
    both = checkpointed(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    nodes = labels.count()
    small = F.broadcast if nodes <= few else (lambda df: df)
    while True:
        heard = both.join(small(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        lower = labels.join(small(heard), "node").where("heard < component")
        told = lower.select(F.explode(F.array("node", "component")).alias("node"), "heard").groupBy("node").agg(F.min("heard").alias("heard"))
        step = labels.join(small(told), "node", "left").select("node", F.least("component", F.coalesce("heard", "component")).alias("component"), F.col("component").alias("before"))
        if nodes > few:
            step = checkpointed(step)
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("root")).where("root < component")
        rows = step.join(small(jump), "component", "left")
        if nodes > few:
            common = [r["component"] for r in step.groupBy("component").count().where(F.col("count") > nodes / HOT_SHARE).collect()]
            hot = F.col("component").isin(common)
            rows = step.where(~hot).join(jump.where(~hot), "component", "left").unionByName(step.where(hot).join(F.broadcast(jump.where(hot)), "component", "left"))
        new = checkpointed(rows.select("node", F.least("component", F.coalesce("root", "component")).alias("component"), "before"))
        changed = new.where("component <> before").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
