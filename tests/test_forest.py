"""The random cut forest against a plain recursive one, in slices, and as a stream's state."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import anomaly
from tidemark.streaming.jobs import run_to_table

BY = ["k"]


class Plain:
    """One tree as nested dicts; boxes and counts are taken from the leaves each time."""

    def __init__(self, forest, tree):
        self.draw = lambda place, depth: float(forest._draw(np.array([tree]), place, depth)[0])
        self.root = None

    def points(self, n):
        return n["points"] if "points" in n else self.points(n["kids"][0]) + self.points(n["kids"][1])

    def offer(self, p, place):
        if self.root is None:
            self.root = {"points": [p]}
            return 1.0
        x = np.array(self.points(self.root))
        lo, hi = x.min(0), x.max(0)
        far = len(x) > 1 and any(v < a - (b - a) or v > b + (b - a) for v, a, b in zip(p, lo, hi, strict=True))
        best = self.walk(self.root, None, 0, p, place, 0)
        return math.log(len(x) + 1) / math.log(2) if far else best

    def put(self, above, side, n):
        if above is None:
            self.root = n
        else:
            above["kids"][side] = n

    def walk(self, node, above, side, p, place, depth):
        x = np.array(self.points(node))
        n = len(x)
        lo, hi = x.min(0), x.max(0)
        below, up = np.minimum(lo, p), np.maximum(hi, p)
        spans = up - below
        if spans.sum() > 0:
            pick, d = self.draw(place, depth) * np.cumsum(spans)[-1], 0
            while np.cumsum(spans)[d] <= pick and d < len(p) - 1:
                d += 1
            cut = below[d] + pick - (np.cumsum(spans)[d] - spans[d])
            if p[d] <= cut < lo[d] or hi[d] <= cut < p[d]:
                leaf = {"points": [p]}
                self.put(above, side, {"kids": [leaf, node] if p[d] <= cut else [node, leaf], "cut": (d, cut)})
                return math.log(n + 1) / math.log(2)
            assert "kids" in node
        elif "points" in node:
            node["points"].append(p)
            return 1.0
        d, cut = node["cut"]
        to = int(p[d] > cut)
        c = len(self.points(node["kids"][to]))
        best = math.log(n + 1) / math.log(c + 2)
        return max(best, self.walk(node["kids"][to], node, to, p, place, depth + 1))

    def forget(self, p):
        def out(node):
            if "points" in node:
                at = next((i for i, q in enumerate(node["points"]) if q is p), None)
                if at is None:
                    return node, False
                del node["points"][at]
                return (node if node["points"] else None), True
            for i in (0, 1):
                kid, found = out(node["kids"][i])
                if found:
                    if kid is None:
                        return node["kids"][1 - i], True
                    node["kids"][i] = kid
                    return node, True
            return node, False

        self.root, found = out(self.root)
        assert found


@pytest.mark.parametrize("dims", [1, 3])
def test_scores_equal_plain_trees(dims):
    rng = random.Random(dims)
    forest = anomaly.CutForest(5, 21, dims, 7)
    plain = [Plain(forest, i) for i in range(5)]
    window = []
    for place in range(300):
        p = np.array([rng.choice([rng.randrange(6), rng.random() * 10, 200.0 if place % 50 == 49 else 5.0]) for _ in range(dims)], float)
        want = np.mean([t.offer(p, place) for t in plain])
        window.append(p)
        if len(window) > 20:
            gone = window.pop(0)
            for t in plain:
                t.forget(gone)
        assert forest.offer(p, place) == pytest.approx(want, rel=1e-12), place
        assert (forest.count[np.arange(5), forest.root] == len(window)).all()


def test_probes_leave_the_forest_as_it_is():
    forest = anomaly.CutForest(10, 33, 1)
    for i in range(60):
        forest.offer(np.array([float(i % 7)]), i)
    first = [forest.offer(np.array([v]), 60, learn=False) for v in (3.0, 100.0)]
    assert first == [forest.offer(np.array([v]), 60, learn=False) for v in (3.0, 100.0)] and first[1] == pytest.approx(math.log(33) / math.log(2))


def series(spark, n):
    rows = [(k, i, i, 50 + 10 * math.sin(i * 0.3) + (400 if k == "a" and i == n - 20 else 0)) for k in ("a", "b") for i in range(n)]
    return spark.createDataFrame(rows, "k string, ts bigint, seq bigint, value double")


def scores_of(df):
    return {(r.k, r.ts): r.score for r in df.collect()}


def test_slices_and_stream_give_the_same_scores(spark, tmp_path):
    d = series(spark, 600)
    settings = {"trees": 8, "size": 32, "shingle_size": 2, "restart": 256}
    batch = scores_of(anomaly.rcf_scores(d, BY, **settings))
    assert len(batch) == 2 * 599 and max(batch, key=batch.get)[0] == "a" and abs(max(batch, key=batch.get)[1] - 580) < 2
    # One key in one go, without slices
    scorer = anomaly.Scorer(8, 32, 2, 42, 256)
    v = [r.value for r in d.where("k = 'b'").orderBy("ts").collect()]
    assert [scorer.score(np.array(v[i : i + 2])) for i in range(599)] == pytest.approx([batch["b", i + 1] for i in range(599)])
    # As a stream, in several triggers
    for i in range(3):
        d.where(f"ts >= {200 * i} AND ts < {200 * i + 200}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert scores_of(run_to_table(anomaly.rcf_stream(stream, BY, **settings), state="rocksdb")) == pytest.approx(batch)


def test_forest_of_an_empty_table(spark):
    assert anomaly.rcf_scores(series(spark, 3).limit(0), BY).count() == 0


def test_runs_side_by_side_share_their_steps(monkeypatch):
    """Eight stretches of a series cost the steps of one, and score as one forest after the other."""
    rng = np.random.default_rng(3)
    points = rng.choice([1.0, 2.0, 50.0], 2000)[:, None] * rng.integers(1, 9, (2000, 1))
    alone, together = (anomaly.Scorer(6, 32, 1, 42, 256) for _ in range(2))
    want = np.array([alone.score(p) for p in points])
    steps, walk = [], anomaly.CutForest._walk
    monkeypatch.setattr(anomaly.CutForest, "_walk", lambda self, *a, **k: steps.append(1) or walk(self, *a, **k))
    got = np.concatenate([together.score_all(points[a:b]) for a, b in ((0, 100), (100, 1900), (1900, 2000))])
    assert (got == want).all() and together.place == 2000
    assert len(steps) <= 100 + 156 + (32 + 256) + 100 + 32


def test_probes_are_dealt_and_scored_together(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "PROBES", 40)
    d = series(spark, 300)
    history, probes = d.where("ts < 200"), d.where("ts >= 200").unionByName(d.limit(1).selectExpr("'new' AS k", "ts", "seq", "value"))
    walks, walk = [], anomaly.CutForest._walk
    got = anomaly.rcf_score_transient(history, probes, BY, trees=5, size=64).collect()
    want = []
    for k in ("a", "b"):
        scorer = anomaly.Scorer(5, 64, 1, 42, anomaly.RESTART, 64)
        scorer.warm(np.array([[r.value] for r in history.where(f"k = '{k}'").orderBy("ts").collect()][-64:]))
        values = [r.value for r in probes.where(f"k = '{k}'").collect()]
        want += [(k, v, scorer.forest.offer(np.array([v]), 64, learn=False)) for v in values]
        monkeypatch.setattr(anomaly.CutForest, "_walk", lambda self, *a, **k: walks.append(1) or walk(self, *a, **k))
        scorer.forest.probe(np.array(values)[:, None], 64)
        monkeypatch.setattr(anomaly.CutForest, "_walk", walk)
    assert sorted((r.k, r.value, r.score) for r in got) == sorted([*want, ("new", 50.0, 1.0)]) and len(walks) == 2
