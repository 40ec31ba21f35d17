"""Randomised components against the exact decomposition."""

import numpy as np
import pytest

from tickloom.operators import reduce


def exact(x):
    scale = x.std(0, ddof=1)
    z = (x - x.mean(0)) / np.where(scale > 0, scale, 1)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    return z, s * s / (len(x) - 1), v.T


def frame(spark, x):
    return spark.createDataFrame([(k, r) for k, r in enumerate(x.tolist())], "id bigint, v array<double>").repartition(5)


def angle(a, b):
    """Sine of the largest angle between the spaces of the columns."""
    return np.linalg.norm(b - a @ (a.T @ b), 2)


@pytest.mark.parametrize("k", [5, None])
def test_components_span_the_exact_space(spark, k):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)) * 2.0 ** -np.arange(8) @ rng.normal(size=(8, 60)) + 1e-3 * rng.normal(size=(600, 60)) + 5
    x[:, 7] = 3.0  # a column that does not vary
    z, values, v = exact(x)
    df = frame(spark, x)
    got = reduce.reduced(df, "id", "v", 0.95, k, most=20).orderBy("id").collect()
    n = k or int((np.cumsum(values) / values.sum() < 0.95).sum()) + 1
    have = np.array([r["components"] for r in got])
    assert have.shape == (600, n)
    assert np.abs(np.abs(have) - np.abs(z @ v[:, :n])).max() < 1e-6
    _, _, found, shares = reduce.components(df.select("v"), 60, n)
    assert angle(v[:, :n], found) < 1e-6 and np.abs(shares / values[:n] - 1).max() < 1e-9
    assert reduce.reduced(df.limit(0), "id", "v").count() == 0


def test_embeddings_keep_their_variance(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    x = np.array([r["embedding"] for r in rows.select("embedding").collect()], float)
    _, values, v = exact(x)
    n = int((np.cumsum(values) / values.sum() < 0.95).sum()) + 1
    got = reduce.reduced(rows, "vec_id", "embedding", 0.95)
    assert len(got.first()["components"]) == n
    _, _, found, _ = reduce.components(rows.selectExpr("cast(embedding as array<double>) as v"), x.shape[1], n)
    assert angle(v[:, :n], found) < 1e-6
