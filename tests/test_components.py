"""Independent components against a FastICA on one array; the job's size must not follow the square of the columns."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import ml


def fast_ica(x, max_iter, seed=42):
    dim, mean = x.shape[1], x.mean(axis=0)
    val, vec = np.linalg.eigh(np.cov(x.T, bias=True))
    white = (vec / np.sqrt(val)).T
    z = (x - mean) @ white.T

    def orthogonal(w):
        u, _, v = np.linalg.svd(w)
        return u @ v

    w = orthogonal(np.random.default_rng(seed).standard_normal((dim, dim)))
    for _ in range(max_iter):
        y = np.tanh(z @ w.T)
        new = orthogonal(y.T @ z / len(z) - (1 - y * y).mean(axis=0)[:, None] * w)
        gap = np.max(np.abs(np.abs((new * w).sum(axis=1)) - 1))
        w = new
        if gap < 1e-6:
            break
    return z @ w.T


def test_ica_equals_one_array_and_its_jobs_stay_small(spark):
    rng = np.random.default_rng(5)
    dim, n = 16, 3000
    x = rng.uniform(-1, 1, (n, dim)) @ rng.standard_normal((dim, dim)) + 1000.0
    names = [f"x{i}" for i in range(dim)]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (n, None, *rows[0][2:])], ["id", *names]).repartition(3)
    got, mixing = ml.ica(df, names, max_iter=50)
    sources = np.array([r.sources for r in got.orderBy("id").collect()])
    assert sources.shape == (n, dim)
    assert np.abs(sources - fast_ica(x, 50)).max() < 1e-5
    assert np.abs(sources @ mixing.T + x.mean(axis=0) - x).max() < 1e-6
    plan = got._jdf.queryExecution().analyzed().expressions().mkString(" ")
    assert len(plan) < 10 * dim * dim  # no term for each pair of columns


def test_ica_reads_packed_rows_of_many_batches(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, (5001, 2)) @ np.array([[1.0, 0.5], [0.2, 1.0]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b float").coalesce(1)
    got, _ = ml.ica(df, ["a", "b"], max_iter=20)
    cov = np.cov(np.array([r.sources for r in got.select(F.col("sources")).collect()]).T, bias=True)
    assert np.abs(cov - np.eye(2)).max() < 1e-6
