"""Dimension reduction by principal components: a randomised range finder with products summed in a tree.

Vectors are standardised (mean 0, sample deviation 1). A d x k basis is multiplied by the covariance without forming it: each task
multiplies its rows, x' (x q), and the d x k products are added up in two levels, so the driver and each adding task hold
d x k numbers, never d x d or the rows. After each of `rounds` such products the basis is made orthogonal again; then the k x k
covariance in the basis is summed the same way and its eigenvectors turn the basis into components.
The fewest components that hold `variance` of the total are kept (the total is the number of columns that vary).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FANS = 32


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    lists = batch.column(0)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def summed(vectors: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(rows) over all batches of rows, added up by FANS tasks and then on the driver. vectors: one array column v."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if len(batch):
                x = part(_matrix(batch, width))
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % FANS]), pa.array([total.ravel()], pa.list_(pa.float64()))], ["fan", "v"])

    def fold(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in rows:
            size = len(batch.column(1).flatten()) // max(1, len(batch))
            for fan, v in zip(batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy().reshape(-1, size) if len(batch) else (), strict=True):
                total[fan] = total[fan] + v if fan in total else v.copy()
        for fan, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([fan]), pa.array([v], pa.list_(pa.float64()))], ["fan", "v"])

    schema = "fan bigint, v array<double>"
    fans = vectors.mapInArrow(add, schema).repartition(FANS, "fan").mapInArrow(fold, schema)
    rows = [np.array(r["v"]) for r in fans.collect()]  # at most FANS sums
    return np.sum(rows, 0) if rows else np.zeros(0)


def components(vectors: DataFrame, width: int, k: int, rounds: int = 12, extra: int = 16, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation, components (columns, by falling variance) and their variances, of which there are at most k."""
    sums = summed(vectors, width, lambda x: np.concatenate([[len(x)], x.sum(0)]))
    n, mean = sums[0], sums[1:] / sums[0]
    square = summed(vectors, width, lambda x: ((x - mean) ** 2).sum(0))
    deviation = np.sqrt(square / max(1.0, n - 1))
    scale = np.where(deviation > 0, deviation, 1.0)
    held = min(width, k + extra)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, held)))[0]

    def times(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            z = (x - mean) / scale
            return z.T @ (z @ q)

        return summed(vectors, width, part).reshape(width, -1) / max(1.0, n - 1)

    for _ in range(1 if held == width else rounds):
        basis = np.linalg.qr(times(basis))[0] if held < width else basis
    within = basis.T @ times(basis)
    values, turn = np.linalg.eigh((within + within.T) / 2)
    order = np.argsort(-values)[:k]
    found = basis @ turn[:, order]
    found = found * np.sign(found[np.abs(found).argmax(0), np.arange(len(order))])  # signs do not depend on the basis
    return mean, scale, found, np.maximum(values[order], 0)


def reduced(rows: DataFrame, key: str, column: str, variance: float = 0.95, k: int | None = None, most: int | None = None, **how) -> DataFrame:
    """key and components: the first k principal components, or the fewest that hold `variance` of it all (of at most `most` if given).

    Rows with a null vector are left out; vectors have one length, that of the first.
    """
    vectors = rows.where(F.col(column).isNotNull()).select(key, F.transform(column, lambda x: x.cast("double")).alias("v"))
    first = vectors.select(F.size("v").alias("n")).first()
    if first is None:
        return vectors.select(key, F.col("v").alias("components"))
    width = first["n"]
    mean, scale, found, values = components(vectors.select("v"), width, min(width, k or most or width), **how)
    total = float(summed(vectors.select("v"), width, lambda x: (((x - mean) / scale) ** 2).sum(0)).sum()) / max(1.0, vectors.count() - 1.0)
    n = min(k or int((np.cumsum(values) / max(total, 1e-300) < variance).sum()) + 1, found.shape[1])
    shared = rows.sparkSession.sparkContext.broadcast((mean, scale, found[:, :n]))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s, q = shared.value
        for batch in batches:
            if len(batch):
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                got = ((x - m) / s) @ q
                ends = pa.array(np.arange(len(got) + 1, dtype=np.int32) * n)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(got.ravel()))], [key, "components"])

    return vectors.mapInArrow(project, f"`{key}` {rows.schema[key].dataType.simpleString()}, components array<double>")
