"""Kendall's tau and DBSCAN against all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import concordance, density_clusters, ml, sliced, stats


def tau_b(xs, ys):
    s = tx = ty = n = 0
    for i in range(len(xs)):
        for j in range(i):
            a, b = np.sign(xs[i] - xs[j]), np.sign(ys[i] - ys[j])
            s, tx, ty, n = s + a * b, tx + (a == 0), ty + (b == 0), n + 1
    return float(s / math.sqrt((n - tx) * (n - ty)))


@pytest.mark.parametrize("rows", [10**6, 25])
def test_kendall_equals_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(sliced, "ROWS", rows)
    rng = random.Random(4)
    pts = [(rng.choice([float(rng.randrange(12)), rng.random() * 12]), 0.0) for _ in range(350)]
    pts = [(x, rng.choice([round(x + rng.gauss(0, 3)), rng.random() * 5, 2.0]) * 1.0) for x, _ in pts] + [(3.0, 3.0)] * 30
    df = spark.createDataFrame([*pts, (None, 1.0), (2.0, None)], "x double, y double")
    got = concordance.kendall_tau(df, "x", "y").first()
    assert got.n == len(pts) and got.tau == pytest.approx(tau_b(*zip(*pts, strict=True)))


def test_kendall_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, 3.0), (2.0, 5.0, 1.0), (3.0, 5.0, 0.0)], "a double, b double, c double")
    got = {(r.x, r.y): r["corr"] for r in stats.corr_matrix(df, ["a", "b", "c"], "kendall").collect()}
    assert got == {("a", "a"): 1.0, ("a", "b"): None, ("a", "c"): -1.0, ("b", "b"): None, ("b", "c"): None, ("c", "c"): 1.0}
    assert concordance.kendall_tau(df.limit(0), "a", "b").first().tau is None
    x = np.random.default_rng(1).integers(0, 50, 400)
    w = np.random.default_rng(2).integers(1, 4, 400)
    assert concordance.inversions(x, w) == sum(w[i] * w[j] for j in range(400) for i in range(j) if x[i] > x[j])


def clusters(x, ids, eps, min_samples):
    near = [{j for j in range(len(x)) if ((x[i] - x[j]) ** 2).sum() <= eps * eps} for i in range(len(x))]
    core = [len(s) >= min_samples for s in near]
    label = {}
    for i in sorted(range(len(x)), key=lambda i: ids[i]):
        if core[i] and i not in label:
            stack = [i]
            label[i] = ids[i]
            while stack:
                for j in near[stack.pop()]:
                    if core[j] and j not in label:
                        label[j] = ids[i]
                        stack.append(j)
    return {ids[i]: (label[i], True) if core[i] else (min((label[j] for j in near[i] if core[j]), default=-1), False) for i in range(len(x))}


@pytest.mark.parametrize(("dims", "eps", "scaler"), [(2, 0.25, "standard"), (16, 2.2, "standard"), (64, 1.2, None), (3, 0.05, "minmax"), (3, 0.3, "robust")])
def test_dbscan_equals_brute_force(spark, monkeypatch, dims, eps, scaler):
    for name, value in (("ROWS_A_PIVOT", 30), ("CHUNK", 40), ("BLOCK", 16)):
        monkeypatch.setattr(density_clusters, name, value)
    rng = np.random.default_rng(dims)
    centres = rng.normal(0, 4, (5, dims))
    x = np.concatenate([centres[i % 5] + rng.normal(0, 0.1 if dims > 10 else 0.6, dims) for i in range(300)]).reshape(300, dims)
    x = np.concatenate((x, rng.normal(0, 5, (60, dims)), np.repeat(x[:2], 25, axis=0)))
    ids = rng.permutation(len(x)) + 1
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(ids, x, strict=True)] + [(9999, *[None] * dims)], f"id long, {', '.join(n + ' double' for n in names)}")
    mid, width = (x.mean(0), x.std(0)) if scaler == "standard" else (x.min(0), np.ptp(x, axis=0)) if scaler == "minmax" else (np.median(x, axis=0), np.subtract(*np.percentile(x, [75, 25], axis=0))) if scaler else (0, 1)
    want = clusters((x - mid) / width, ids.tolist(), eps, 4)
    got = {r.id: (r.cluster, r.core) for r in density_clusters.dbscan(df, names, "id", eps=eps, min_samples=4, scaler=scaler).collect()}
    assert got == want and len({c for c, _ in want.values()}) > 2


def test_dbscan_edges(spark):
    df = spark.createDataFrame([(1, 1.0)], "id long, a double")
    assert [tuple(r) for r in density_clusters.dbscan(df, ["a"], "id", min_samples=1).collect()] == [(1, 1, True)]
    assert density_clusters.dbscan(df.limit(0), ["a"], "id").count() == 0
    with pytest.raises(ValueError, match="scaler"):
        density_clusters.dbscan(df, ["a"], "id", scaler="other")


def test_dbscan_groups_are_bounded(spark, monkeypatch):
    """Where eps is as wide as the table, a group's halo is the whole table; no task may hold it."""
    for name, value in (("ROWS_A_PIVOT", 100), ("CHUNK", 40), ("BLOCK", 16), ("MEMBERS", 50)):
        monkeypatch.setattr(density_clusters, name, value)
    kept, write = {}, density_clusters.materialize
    monkeypatch.setattr(density_clusters, "materialize", lambda df, name: kept.setdefault(name, write(df, name)))
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"f{i} double" for i in range(16)))
    got = {r.id: (r.cluster, r.core) for r in density_clusters.dbscan(df, [f"f{i}" for i in range(16)], "id", eps=0.85, min_samples=5, scaler=None).collect()}
    assert got == clusters(x, list(range(500)), 0.85, 5) and len(set(got.values())) > 3
    groups = kept["groups"]
    keys = [c for c in ("cell", "chunk", "lot") if c in groups.columns]
    assert max(r["count"] for r in groups.groupBy(*keys).count().collect()) <= 2 * (40 + 50)


def test_equal_points_of_a_plane_are_one(spark, monkeypatch):
    kept, write = {}, ml.materialize
    monkeypatch.setattr(ml, "materialize", lambda df, name: kept.setdefault(name, write(df, name)))
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.integers(0, 9, (60, 2)), np.repeat(rng.integers(20, 60, (12, 2)), [1, 2, 3, 4, 5, 6] * 2, axis=0))).astype(float)
    ids = rng.permutation(len(x)) + 1
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(ids, x, strict=True)] + [(999, None, 1.0)], "id long, x double, y double")
    got = {r.id: (r.cluster, r.core) for r in ml.dbscan(df, "x", "y", "id", eps=1.5, min_samples=4).collect()}
    assert got == clusters(x, ids.tolist(), 1.5, 4) and len({c for c, _ in got.values()}) > 3
    assert kept["points"].count() == len(np.unique(x, axis=0))


def test_dbscan_deals_wide_points_in_pieces():
    x = np.random.default_rng(2).normal(size=(1000, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(x.tolist()), pa.array([1] * 1000)], names=["id", "vec", "w"])
    pieces = list(density_clusters._dealt(batch, x[:40], 100.0))
    assert max(p.num_rows for p in pieces) <= density_clusters.DEALT
    got = [(r["id"], r["cell"]) for p in pieces for r in p.to_pylist()]
    assert len(got) == 40_000 and set(got) == {(i, c) for i in range(1000) for c in range(40)}
    assert sum(r["home"] for p in pieces for r in p.to_pylist()) == 1000
