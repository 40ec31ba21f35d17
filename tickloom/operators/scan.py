"""Places, running sums and chunks of long ordered series, without a window over a whole series.

Rows are range-partitioned by key and order, once. What a partition adds to the rows after it is a row a (key, partition); these few
rows are summed in order, and each row adds its own place within its partition. So a key with most of the rows, or no key at
all, is as many tasks as there are partitions. The partitioned rows are checkpointed, as both steps read them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.session import shared_folder

CHUNK = 8192
#: Rows that a kernel gets at once, about: many short series share the cost of a call.
PACK = 1 << 16
Kernel = Callable[[pa.Table, np.ndarray], pa.Table]


def materialised(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: rows and partitions stay as they are, also when executors are lost."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def _ranged(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """df with __part and __at, the row's place in its range partition, in order."""
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    held = materialised(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    return held.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")


def placed(df: DataFrame, by: list[str], order: list[str | Column], name: str = "position") -> DataFrame:
    """df with the place of each row among those of its key, from 0. Rows equal in order are placed in any order."""
    rows = _ranged(df, by, order)
    held = rows.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part")) - F.col("__n")
    starts = held.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__part").alias("__p"), (before - F.col("__first")).alias("__shift"))
    same = (F.col("__part") == F.col("__p")) & _same(by)
    return rows.join(starts, same).withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__p", "__shift", *[f"__k_{c}" for c in by])


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return out


def running_sums(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, Column], digits: int | None = None) -> DataFrame:
    """df with the running sum of each value up to and with the row. Rows equal in order are summed in any order.

    digits: values are summed as decimals of so many digits after the point, so that sums do not depend on how rows are dealt out.
    """
    value = lambda c: c if digits is None else c.cast(f"decimal(38,{digits})")
    rows = _ranged(df.withColumns({f"__v_{n}": value(c) for n, c in sums.items()}), by, order)
    inside = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__s_{n}": F.sum(f"__v_{n}").over(inside) for n in sums})
    held = rows.groupBy(*by, "__part").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums])
    joined = rows.join(starts, (F.col("__part") == F.col("__p")) & _same(by))
    total = lambda n: F.col(f"__b_{n}") + F.coalesce(F.col(f"__s_{n}"), F.lit(0))
    dropped = [f"__{x}_{n}" for n in sums for x in "vsb"] + [f"__k_{c}" for c in by]
    return joined.withColumns({n: total(n) for n in sums}).drop("__part", "__at", "__p", *dropped)


def by_chunks(rows: DataFrame, by: list[str], kernel: Kernel, schema: StructType | str, halo: int = 0, chunk: int = CHUNK, position: str = "position") -> DataFrame:
    """kernel over chunks of consecutive rows of each key, each with the `halo` rows before it. rows: placed().

    kernel gets many chunks one after another, in order of position, and the place of each row in its chunk, halo rows included; it returns
    as many rows. Those of the halo are left out.
    """
    size = max(chunk, halo)
    own = F.floor(F.col(position) / size)
    also = F.when(F.col(position) >= (own + 1) * size - halo, own + 1) if halo else F.lit(None).cast("bigint")
    sent = rows.withColumn("__chunk", F.explode(F.array_compact(F.array(own, also))))
    keys = [*by, "__chunk"]
    return _mapped(sent.repartition(*keys).sortWithinPartitions(*keys, position), kernel, schema, position, size)


def split(df: DataFrame, by: list[str], chunk: int = CHUNK, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the keys that have at most `chunk` rows, rows of the others or None if there are none). counted: rows that cost less to count, of the same keys and for none fewer."""
    sizes = (df if counted is None else counted).groupBy(*by).agg(F.count("*").alias("__n"))
    large = materialised(sizes.where(F.col("__n") > chunk).select(*[F.col(c).alias(f"__k_{c}") for c in by]))
    if large.isEmpty():
        return df, None
    return df.join(large, _same(by), "left_anti"), df.join(large, _same(by), "left_semi")


def by_packs(df: DataFrame, by: list[str], order: list[str | Column], kernel: Kernel, schema: StructType | str) -> DataFrame:
    """kernel, as in by_chunks(), over whole series, many at once: for series that a task can hold. The place of a row is its place in its series."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    rows = df.withColumns({"__position": place, "__chunk": F.lit(0)})
    return _mapped(rows.sortWithinPartitions(*by, *order), kernel, schema, "__position", 0)


def by_series(df: DataFrame, by: list[str], order: list[str | Column], kernel: Kernel, schema: StructType, halo: int, chunk: int = CHUNK, counted: DataFrame | None = None) -> DataFrame:
    """kernel over series of any length: short ones whole, which takes one shuffle, and only those of more than `chunk` rows by places and chunks with a halo."""
    short, large = split(df, by, chunk, counted)
    got = by_packs(short, by, order, kernel, schema)
    return got if large is None else got.unionByName(by_chunks(placed(large, by, order), by, kernel, schema, halo, chunk))


def _mapped(rows: DataFrame, kernel: Kernel, schema: StructType | str, position: str, size: int) -> DataFrame:
    """kernel over packs of whole segments of sorted rows. A segment ends where positions do not go on or the chunk changes."""
    names = schema.names if isinstance(schema, StructType) else rows.sparkSession.createDataFrame([], schema).columns
    dropped = [c for c in ("__chunk", "__position") if c in rows.columns]

    def finished(table: pa.Table, starts: np.ndarray) -> list[pa.RecordBatch]:
        at, chunks = (table.column(c).to_numpy() for c in (position, "__chunk"))
        place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        out = kernel(table.drop_columns(dropped), place).select(names)
        own = at >= chunks * size
        return (out if own.all() else out.filter(pa.array(own))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            n += len(batch)
            if n >= PACK:
                table = pa.Table.from_batches(held).combine_chunks()
                starts = _starts(table, position)
                if len(starts) > 1:
                    yield from finished(table.slice(0, starts[-1]), starts[:-1])
                    table = table.slice(starts[-1])
                held, n = table.to_batches(), len(table)
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from finished(table, _starts(table, position))

    return rows.mapInArrow(run, schema)


def _starts(table: pa.Table, position: str) -> np.ndarray:
    at, chunks = (table.column(c).to_numpy() for c in (position, "__chunk"))
    return np.append(0, 1 + np.flatnonzero((np.diff(at) != 1) | (np.diff(chunks) != 0)))
