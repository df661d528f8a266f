"""Neighbours in and beside large groups of copies."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import ann


def test_neighbours_among_thousands_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4000, 16))
    copies = base[:1].repeat(3000, axis=0)  # exact copies of one vector
    near = base[1:2] + rng.normal(size=(3000, 16)) * 1e-4  # closer than the codebooks resolve
    beside = base[:1] + rng.normal(size=(30, 16)) * 1e-2
    x = np.concatenate((base, copies, near, beside))
    asked = [*range(7000, 7040), *range(10_000, 10_030)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.fit(ann.valid_vectors(df.where("vec_id < 4000"), "vec_id", "embedding"))  # as a sample of a far larger table
    got = {}
    for r in ann.search(df, F.col("vec_id").isin(asked), k=10, index=index).collect():
        got.setdefault(r.query_id, []).append(r.score)
    hits = 0
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += sum(s <= np.sort(d)[9] + 1e-12 for s in got[q])
    assert hits >= 0.9 * 10 * len(asked), hits / (10 * len(asked))


def test_recall_on_the_given_table(spark):
    """All queries of the table against brute force; also with the cells that a far larger table would get."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in e.select("vec_id", "embedding").collect())
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    fine = ann.fit(ann.valid_vectors(e, "vec_id", "embedding"), cells=3 * len(rows) // 40)
    for index in (None, fine):
        got = {}
        for r in ann.search(e, F.col("vec_id") % 100 == 0, k=10, index=index).collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        asked = [i for i in ids.tolist() if i % 100 == 0]
        hits = 0
        for q in asked:
            d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
            d[ids == q] = np.inf
            assert len(got[q]) == 10 and all(abs(d[ids == v][0] - s) < 1e-9 for v, s in got[q])
            hits += len({v for v, _ in got[q]} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        assert hits >= 0.9 * 10 * len(asked), hits / (10 * len(asked))
    assert len(fine.centroids) >= 3 * len(rows) // 40


def test_sparse_cells_are_probed_on(spark):
    """A query whose own cell holds too few rows looks at further ones."""
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.normal(size=(200, 8)), 50 + rng.normal(size=(3, 8))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.fit(ann.valid_vectors(df, "vec_id", "embedding"), cells=5)
    index.probes = 1
    got = ann.search(df, F.col("vec_id") == 202, k=10, index=index).collect()
    d = np.sqrt(((x - x[202]) ** 2).sum(axis=1))
    assert len(got) == 10 and [r.vec_id for r in sorted(got, key=lambda r: r["rank"])][:2] == np.argsort(d)[1:3].tolist()


def test_queries_of_a_cell_are_dealt_to_lots(spark, monkeypatch):
    """More queries than a group may hold: the same neighbours."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, ann.search(df, F.col("vec_id") % 2 == 0, k=5).collect()))
    monkeypatch.setattr(ann, "GROUP_QUERIES", 20)
    monkeypatch.setattr(ann, "GROUP_ROWS", 50)
    assert sorted(map(tuple, ann.search(df, F.col("vec_id") % 2 == 0, k=5).collect())) == want and len(want) == 1000
