"""Correlations of many columns by blocked Gram matrices.

A task adds up, batch by batch, the products of all pairs of columns as matrix products (counts, sums and squares of the rows that
have both values too), keeps them in blocks of `width` columns, and hands on a row a block. Blocks are summed in two
levels, so no task sees the blocks of all others. With groups, rows are range-partitioned by group first; a large group is spread over
partitions, whose partial products add up like any others.

Columns beyond what `cells` allows are done in several passes over the rows, each over some of the block pairs, so that a
task holds at most 6 x cells numbers. Values are shifted by the means of a few rows, which changes no result, only its rounding.

Nulls and NaN are no values. r is null where a column of the pair has no variance in their common rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tickloom.operators.scan import materialised

WIDTH = 64
CELLS = 1 << 21
FANS = 32


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(6, columns of x, columns of y): n, sum x, sum y, sum xx, sum yy, sum xy over rows that have both."""
    mx, my = (~np.isnan(a) for a in (x, y))
    x0, y0 = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my = mx.astype(float), my.astype(float)
    return np.stack([mx.T @ my, x0.T @ my, mx.T @ y0, (x0 * x0).T @ my, mx.T @ (y0 * y0), x0.T @ y0])


def pearson(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n and r (NaN without variance) of products()."""
    n, sx, sy, sxx, syy, sxy = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        flat = (vx <= 1e-14 * sxx) | (vy <= 1e-14 * syy) | (n < 1)
        r = np.where(flat, np.nan, (sxy - sx * sy / n) / np.sqrt(vx * vy))
    return n, np.clip(r, -1, 1)


def shifts(df: DataFrame, columns: list[str], rows: int = 1024) -> np.ndarray:
    """Means of a few rows; 0 where they have none."""
    sample = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).limit(rows).toArrow()
    x = np.stack([sample.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1) if len(columns) else np.zeros((0, 0))
    with np.errstate(invalid="ignore", all="ignore"):
        m = np.array([np.mean(v[np.isfinite(v)]) if np.isfinite(v).any() else 0.0 for v in x.T])
    return m


def correlations(df: DataFrame, columns: list[str], by: list[str] | None = None, complete: bool = False, width: int = WIDTH, cells: int = CELLS) -> DataFrame:
    """by, a, b, n, r of every pair of columns, a before b in order of name. complete: only rows without a null in any column count."""
    by, columns = by or [], sorted(columns)
    rows = df.select(*by, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    shift = shifts(rows, columns)
    blocks = [columns[k : k + width] for k in range(0, len(columns), width)]
    pairs = [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))]
    per_pass = max(1, cells // (width * width))
    if by:
        rows = rows.withColumn("__salt", F.xxhash64(*columns)).repartitionByRange(*by, "__salt").sortWithinPartitions(*by).drop("__salt")
    keys = [StructField(c, df.schema[c].dataType) for c in by]
    schema = StructType([*keys, StructField("i", IntegerType()), StructField("j", IntegerType()), StructField("fan", LongType()), StructField("sums", ArrayType(DoubleType()))])
    parts = [_partial(rows, by, blocks, shift, pairs[k : k + per_pass], complete, schema) for k in range(0, len(pairs), per_pass)]
    if not parts:
        return df.sparkSession.createDataFrame([], StructType([*keys, StructField("a", StringType()), StructField("b", StringType()), StructField("n", LongType()), StructField("r", DoubleType())]))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)

    def summed(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(s) for s in table.column("sums").to_pylist()], 0) if len(table) > 1 else np.asarray(table.column("sums")[0].as_py())
        return table.slice(0, 1).select([*by, "i", "j", "fan"]).append_column("sums", pa.array([total], pa.list_(pa.float64())))

    def paired(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        total = np.asarray(summed(table).column("sums")[0].as_py()).reshape(6, len(blocks[i]), len(blocks[j]))
        n, r = pearson(total)
        at, to = np.triu_indices(len(blocks[i]), 1) if i == j else (a.ravel() for a in np.indices(n.shape))
        names = {"a": [blocks[i][k] for k in at], "b": [blocks[j][k] for k in to]}
        head = {c: pa.array([table.column(c)[0].as_py()] * len(at), table.schema.field(c).type) for c in by}
        return pa.table(head | {k: pa.array(v, pa.string()) for k, v in names.items()} | {"n": pa.array(n[at, to].astype(np.int64)), "r": pa.array(r[at, to], pa.float64(), from_pandas=True)})

    fans = found.groupBy(*by, "i", "j", "fan").applyInArrow(summed, schema)
    out = StructType([*keys, StructField("a", StringType()), StructField("b", StringType()), StructField("n", LongType()), StructField("r", DoubleType())])
    return fans.groupBy(*by, "i", "j").applyInArrow(paired, out)


def _partial(rows: DataFrame, by: list[str], blocks: list[list[str]], shift: np.ndarray, pairs: list[tuple[int, int]], complete: bool, schema: StructType) -> DataFrame:
    """A row a group, partition and block pair."""
    columns = [c for b in blocks for c in b]
    ends = np.cumsum([0, *map(len, blocks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fan = TaskContext.get().partitionId() % FANS
        held: dict[tuple, list[np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            head = [pa.array([k[c] for k in held for _ in pairs], types[c]) for c in range(len(by))]
            ij = [pa.array([p[x] for _ in held for p in pairs], pa.int32()) for x in (0, 1)]
            sums = pa.array([s.ravel() for v in held.values() for s in v], pa.list_(pa.float64()))
            out = pa.RecordBatch.from_arrays([*head, *ij, pa.array([fan] * len(sums), pa.int64()), sums], [*by, "i", "j", "fan", "sums"])
            held.clear()
            return out

        types: list[pa.DataType] = []
        for batch in batches:
            if not len(batch):
                continue
            types = [batch.column(k).type for k in range(len(by))]
            x = np.stack([batch.column(len(by) + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(columns))], 1) - shift
            if complete:
                x[np.isnan(x).any(1)] = np.nan
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(len(by))], strict=True)) if by else [()] * len(batch)
            starts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)] if by else [0, len(batch)]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if keys[lo] not in held and held:
                    yield flush()
                new = [products(x[lo:hi, ends[i] : ends[i + 1]], x[lo:hi, ends[j] : ends[j + 1]]) for i, j in pairs]
                held[keys[lo]] = [a + b for a, b in zip(held[keys[lo]], new, strict=True)] if keys[lo] in held else new
        if held:
            yield flush()

    return rows.mapInArrow(run, schema)


def regime_collinear(df: DataFrame, columns: list[str], limit: float = 0.9, least: int = 100, top: int = 30) -> DataFrame:
    """a, b, r of the pairs of market-wide columns with |r| of at least limit, over rows that have all of them, if there are `least`; the `top` largest."""
    rows = materialised(df).select(*columns)  # a row a date
    r = correlations(rows, columns, complete=True).where((F.col("n") >= least) & (F.abs("r") >= limit))
    return r.orderBy(F.desc(F.round(F.abs("r"), 9)), "a", "b").limit(top).select("a", "b", "r")
