"""Anomaly scores by random cut forests that learn point by point, per key, in batch and as a stream's state.

A forest's cuts are drawn from a hash of (seed, tree, the point's place in its key, depth), so that a score
depends on the key's rows alone - not on partitions, retries or micro-batches.  Every ``RESTART`` rows a forest is
grown anew from the ``size`` rows before, which is all that it remembers anyway: batch jobs deal a hot key's rows in such slices.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sliced import joined, with_index, with_row_halo

RESTART = 16_384
#: Forests that grow side by side in one task.
SIDE_BY_SIDE = 96
#: Probes of one key that one task scores.
PROBES = 100_000
_NONE = -1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _share(salt: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """Even in [0, 1), by the tree's salt, the point's place and the depth."""
    with np.errstate(over="ignore"):
        x = salt ^ _mix((place * 64 + (depth + 1)).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (_mix(x) >> np.uint64(11)) / float(1 << 53)


class CutForest:
    """Random cut trees over the last ``size`` points; all trees are walked together, one level a step.

    A new point starts at the root.  A cut is drawn through the box of a node and the point; if it parts the two, the point
    becomes the node's sibling there, else the point goes on by the node's own cut.  A point equal to a leaf joins it.

    ``copies`` forests of their own points may grow side by side: a step's cost in calls is shared by all their trees.
    Nodes lie in flat arrays, those of a tree in one stretch; a tree's place among all copies is its lane.
    """

    def __init__(self, trees: int, size: int, dims: int, seed: int = 42, copies: int = 1):
        self.trees, self.size, self.dims = trees, size, dims
        lanes, self.room = trees * copies, 2 * size + 2
        nodes = lanes * self.room
        self._child = np.full(2 * nodes, _NONE)  # of node n at 2 n and 2 n + 1
        self._parent, self._dim, self._count = np.full(nodes, _NONE), np.zeros(nodes, np.int32), np.zeros(nodes, np.int64)
        self._cut, self._low, self._high = np.zeros(nodes), np.zeros((nodes, dims)), np.zeros((nodes, dims))
        self._root = np.full(lanes, _NONE)
        self._free, self._left_free = np.arange(nodes), np.full(lanes, self.room)
        self._leaf_of = np.full((size, lanes), _NONE)  # of each slot of the sliding window
        self.first, self.held = 0, 0
        with np.errstate(over="ignore"):
            self._salt = _mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self._log = np.log(np.arange(size + 3).clip(1))

    @property
    def count(self) -> np.ndarray:
        """Points below each node of each tree."""
        return self._count.reshape(-1, self.room)

    @property
    def root(self) -> np.ndarray:
        """Each tree's root among its nodes."""
        return self._root % self.room

    def copy_of(self, i: int, points: int) -> CutForest:
        """The i-th of the forests that grew side by side, as a forest of its own; it has learned so many points."""
        found = CutForest(self.trees, self.size, self.dims)
        found._salt = self._salt
        nodes, lanes = slice(i * len(found._parent), (i + 1) * len(found._parent)), slice(i * self.trees, (i + 1) * self.trees)
        move = lambda x: np.where(x == _NONE, _NONE, x - nodes.start)
        found._child, found._parent, found._free = move(self._child[2 * nodes.start : 2 * nodes.stop]), move(self._parent[nodes]), move(self._free[nodes])
        for name in ("_dim", "_count", "_cut", "_low", "_high"):
            setattr(found, name, getattr(self, name)[nodes].copy())
        found._root, found._left_free, found._leaf_of = move(self._root[lanes]), self._left_free[lanes].copy(), move(self._leaf_of[:, lanes])
        found.held = min(points, self.size - 1)
        found.first = (points - found.held) % self.size
        return found

    def _take(self, lanes: np.ndarray) -> np.ndarray:
        self._left_free[lanes] -= 1
        return self._free[lanes * self.room + self._left_free[lanes]]

    def _give(self, lanes: np.ndarray, nodes: np.ndarray) -> None:
        self._free[lanes * self.room + self._left_free[lanes]] = nodes
        self._left_free[lanes] += 1

    def _draw(self, trees: np.ndarray, place: int | np.ndarray, depth: int) -> np.ndarray:
        return _share(self._salt[trees], np.asarray(place), depth)

    def offer(self, point: np.ndarray, place: int, learn: bool = True) -> float:
        """The point's score against the trees as they are, the mean of the largest displacement on its way; then it is learned.

        A point on the side of c points at a node of n: ln(n + 1) / ln(c + 2), with the point on both sides; where it is
        parted from all n: ln(n + 1) / ln(2).  A point beyond the root's box by more than its width is parted there.
        """
        points = np.asarray(point, float)[None]
        return float((self.offer_each(points, np.array([place])) if learn else self.probe(points, place))[0])

    def offer_each(self, points: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Scores of a point for each of the first copies, which learn them; a copy that is left out once stays out."""
        lane = np.arange(len(points) * self.trees)
        if not self.held:
            self._root[lane] = self._new_leaf(lane, np.repeat(points, self.trees, axis=0), self.first)
            self._parent[self._root[lane]] = _NONE
            self.held = 1
            return np.ones(len(points))
        best = self._walk(lane, np.repeat(points, self.trees, axis=0), np.repeat(places, self.trees), learn=True)
        self.held += 1
        if self.held > self.size - 1:
            self._forget(lane)
        return best.reshape(-1, self.trees).mean(axis=1)

    def probe(self, points: np.ndarray, place: int) -> np.ndarray:
        """Scores of points at the same place, none of which is learned."""
        if not self.held:
            return np.ones(len(points))
        out = []
        for i in range(0, len(points), 1024):
            some = points[i : i + 1024]
            lane = np.tile(np.arange(self.trees), len(some))
            best = self._walk(lane, np.repeat(some, self.trees, axis=0), np.full(len(lane), place), learn=False)
            out.append(best.reshape(-1, self.trees).mean(axis=1))
        return np.concatenate([np.zeros(0), *out])

    def _walk(self, lane: np.ndarray, point: np.ndarray, place: np.ndarray, learn: bool) -> np.ndarray:
        """The largest displacement of each lane's point; with ``learn``, lanes are different trees and take their points in."""
        log, node = self._log, self._root[lane]
        low, high, n = self._low.take(node, axis=0), self._high.take(node, axis=0), self._count.take(node)
        far = np.flatnonzero(((point < low - (high - low)) | (point > high + (high - low))).any(axis=1) & (n > 1))
        at_once = log[n[far] + 1] / log[2]
        found, best, back = np.ones(len(lane)), np.ones(len(lane)), np.arange(len(lane))
        salt, depth = self._salt[lane % self.trees], 0
        passed, widened, parted, joined = [], [], [], []  # what the trees learn when all lanes have come to their ends
        while len(node):
            low, high = self._low.take(node, axis=0), self._high.take(node, axis=0)
            ends = leaf = self._child.take(2 * node) == _NONE
            inside = (point >= low) & (point <= high)
            i = np.flatnonzero(~(inside[:, 0] if self.dims == 1 else inside.all(axis=1)))  # a cut parts no others from a node
            if len(i):
                low, high, x, own_leaf = low[i], high[i], point[i], leaf[i]
                below = np.minimum(low, x)
                span = np.maximum(high, x) - below
                pick = _share(salt[i], place[i], depth)
                if self.dims == 1:
                    total, dim, l_, h_, x_ = span[:, 0], np.zeros(len(i), np.int32), low[:, 0], high[:, 0], x[:, 0]
                    cut = below[:, 0] + pick * total
                else:
                    upto = np.cumsum(span, axis=1)
                    total = upto[:, -1]
                    pick = pick * total
                    dim, at = np.minimum((upto <= pick[:, None]).sum(axis=1), self.dims - 1), np.arange(len(i))
                    l_, h_, x_ = low[at, dim], high[at, dim], x[at, dim]
                    cut = below[at, dim] + pick - (upto[at, dim] - span[at, dim])
                apart = ((x_ <= cut) & (cut < l_)) | ((h_ <= cut) & (cut < x_))
                apart = (total > 0) & (apart | own_leaf)  # of two different points, rounding may leave the cut on neither side
                out = i[apart]
                best[out] = np.maximum(best[out], log[n[out] + 1] / log[2])
                if learn:
                    own = own_leaf & ~((cut < np.maximum(l_, x_)) & (cut >= np.minimum(h_, x_)))
                    middle = np.where(own, np.minimum(l_, x_), cut)  # a cut that parts a leaf from the point for sure
                    wider = i[~(apart | own_leaf)]
                    widened.append((node[wider], point[wider]))
                    parted.append((lane[out], node[out], dim[apart], middle[apart], point[out]))
                ends = leaf.copy()
                ends[out] = False
            if learn:
                joined.append((lane[ends], node[ends]))
            if len(i):
                ends[out] = True
            go = np.flatnonzero(~ends)
            if len(go) < len(node):
                found[back] = best  # those that go on write theirs again
                node, n, point, salt, place, best, back, lane = node[go], n[go], point[go], salt[go], place[go], best[go], back[go], lane[go]
            passed.append(node)
            x = point[:, 0] if self.dims == 1 else point[np.arange(len(node)), self._dim.take(node)]
            node = self._child.take(2 * node + (x > self._cut.take(node)))
            over, n = log.take(n + 1), self._count.take(node)
            best = np.maximum(best, over / log.take(n + 2))
            depth += 1
        if learn:
            slot = (self.first + self.held) % self.size
            self._count[np.concatenate(passed)] += 1
            if widened:
                node, x = (np.concatenate(c) for c in zip(*widened, strict=True))
                self._low[node], self._high[node] = np.minimum(self._low[node], x), np.maximum(self._high[node], x)
                self._part(*(np.concatenate(c) for c in zip(*parted, strict=True)), slot)
            self._join(*(np.concatenate(c) for c in zip(*joined, strict=True)), slot)
        found[far] = at_once
        return found

    def _new_leaf(self, lane: np.ndarray, point: np.ndarray, slot: int) -> np.ndarray:
        leaf = self._take(lane)
        self._child[2 * leaf] = self._child[2 * leaf + 1] = _NONE
        self._low[leaf] = self._high[leaf] = point
        self._count[leaf] = 1
        self._leaf_of[slot, lane] = leaf
        return leaf

    def _join(self, lane: np.ndarray, leaf: np.ndarray, slot: int) -> None:
        self._count[leaf] += 1
        self._leaf_of[slot, lane] = leaf

    def _part(self, lane: np.ndarray, node: np.ndarray, dim: np.ndarray, cut: np.ndarray, point: np.ndarray, slot: int) -> None:
        """A branch in the place of ``node``, with it and the point as its children."""
        if not len(lane):
            return
        leaf, branch, above = self._new_leaf(lane, point, slot), self._take(lane), self._parent[node]
        side = point[np.arange(len(lane)), dim] > cut
        self._child[2 * branch + side], self._child[2 * branch + ~side] = leaf, node
        self._dim[branch], self._cut[branch] = dim, cut
        self._low[branch], self._high[branch] = np.minimum(self._low[node], point), np.maximum(self._high[node], point)
        self._count[branch] = self._count[node] + 1
        self._parent[branch], self._parent[leaf], self._parent[node] = above, branch, branch
        self._hang(lane, above, node, branch)

    def _hang(self, lane: np.ndarray, above: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        top = above == _NONE
        self._root[lane[top]] = new[top]
        above, old, new = above[~top], old[~top], new[~top]
        self._child[2 * above + (self._child[2 * above + 1] == old)] = new

    def _forget(self, lane: np.ndarray) -> None:
        """Takes the oldest point out of the trees."""
        leaf = self._leaf_of[self.first, lane]
        self._count[leaf] -= 1
        node = self._parent[leaf]
        gone = np.flatnonzero(self._count[leaf] == 0)
        dead, branch = leaf[gone], node[gone]
        other, above = self._child[2 * branch + (self._child[2 * branch] == dead)], self._parent[branch]
        self._parent[other] = above
        self._hang(lane[gone], above, branch, other)
        self._give(lane[gone], dead)
        self._give(lane[gone], branch)
        node[gone] = above
        while len(node := node[node != _NONE]):
            self._count[node] -= 1
            node = self._parent[node]
        node = above
        while len(node := node[node != _NONE]):  # a box above one that stays as it was stays too
            a, b = self._child[2 * node], self._child[2 * node + 1]
            low, high = np.minimum(self._low[a], self._low[b]), np.maximum(self._high[a], self._high[b])
            moved = ((low != self._low[node]) | (high != self._high[node])).any(axis=1)
            node = node[moved]
            self._low[node], self._high[node] = low[moved], high[moved]
            node = self._parent[node]
        self.first = (self.first + 1) % self.size
        self.held -= 1


def score_runs(runs: list[tuple[np.ndarray, int]], trees: int, size: int, seed: int) -> tuple[list[np.ndarray], CutForest]:
    """Scores of runs (points, place of the first), each by a forest of its own from nothing on, and the last run's forest."""
    order = sorted(range(len(runs)), key=lambda i: -len(runs[i][0]))
    lengths = np.array([len(runs[i][0]) for i in order])
    forest = CutForest(trees, size + 1, runs[0][0].shape[1], seed, len(runs))
    points, scores = np.zeros((lengths[0], len(runs), forest.dims)), np.zeros((lengths[0], len(runs)))
    for k, i in enumerate(order):
        points[: lengths[k], k] = runs[i][0]
    places = np.array([runs[i][1] for i in order])
    for step in range(lengths[0]):
        k = int((lengths > step).sum())
        scores[step, :k] = forest.offer_each(points[step, :k], places[:k] + step)
    found = {i: scores[: lengths[k], k] for k, i in enumerate(order)}
    return [found[i] for i in range(len(runs))], forest.copy_of(order.index(len(runs) - 1), len(runs[-1][0]))


class Scorer:
    """A key's forest and its last points: scores each point, learns it, and starts anew every ``restart`` points."""

    def __init__(self, trees: int, size: int, dims: int, seed: int, restart: int, place: int = 0):
        self.settings, self.restart = (trees, size + 1, dims, seed), restart
        self.size, self.place, self.last = size, place, []
        self.forest = CutForest(*self.settings)

    def warm(self, points: np.ndarray) -> None:
        """Learns the points that lie just before ``place``."""
        self.last = [*points][-self.size :]
        for i, p in enumerate(self.last):
            self.forest.offer(p, self.place - len(self.last) + i)

    def score(self, point: np.ndarray) -> float:
        if self.place and self.place % self.restart == 0:
            self.forest = CutForest(*self.settings)
            self.warm(self.last)
        found = self.forest.offer(point, self.place)
        self.last = [*self.last[-self.size + 1 :], point]
        self.place += 1
        return found

    def score_all(self, points: np.ndarray) -> np.ndarray:
        """``score`` of each point in turn; stretches between new starts grow side by side."""
        head = min(-self.place % self.restart, len(points))
        out = [np.array([self.score(p) for p in points[:head]], float)]
        trees, _, dims, seed = self.settings
        block = SIDE_BY_SIDE * self.restart
        for i in range(head, len(points), block):
            before = np.array(self.last, float).reshape(-1, dims)
            known = np.concatenate((before, points[i : i + block]))
            starts = range(len(before), len(known), self.restart)
            runs = [(known[max(0, a - self.size) : a + self.restart], self.place + max(0, a - self.size) - len(before)) for a in starts]
            found, self.forest = score_runs(runs, trees, self.size, seed)
            out += [f[a - max(0, a - self.size) :] for f, a in zip(found, starts, strict=True)]
            self.place += len(known) - len(before)
            self.last = [*known[-self.size :]]
        return np.concatenate(out)


def shingle(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """Arrays of k consecutive values; null until there are k."""
    d = with_row_halo(df, by, k)
    got = F.collect_list("value").over(Window.partitionBy(*by, "slice").orderBy("idx").rowsBetween(-(k - 1), 0))
    return d.withColumn("shingle", F.when(F.size(got) == k, got)).where("own").select(*df.columns, "shingle")


def _keys(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)


def rcf_scores(
    df: DataFrame, by: list[str], *, trees: int = 50, size: int = 256, shingle_size: int = 1, seed: int = 42, restart: int = RESTART
) -> DataFrame:
    """Each row scored against the ``size`` rows of its key before it, in (ts, seq) order, before it is learned."""
    d = shingle(df, by, shingle_size).where("shingle IS NOT NULL").select(*by, "ts", "seq", "shingle")
    restart = max(restart, 8 * size)
    slices = d.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / restart).alias("n")).agg(F.sum("n")).first()[0] or 1
    d = with_row_halo(with_index(d, by), by, size, rows=restart, whole=False)

    def flush(held: list[tuple[list, list]]) -> Iterator[pd.DataFrame]:
        runs = [(np.concatenate(points), int(rows[0]["idx"].iloc[0])) for points, rows in held]
        scores, _ = score_runs(runs, trees, size, seed)
        for (_, rows), found in zip(held, scores, strict=True):
            pdf = pd.concat(rows).assign(score=found)
            yield pdf.loc[pdf["own"], [*by, "ts", "seq", "score"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = [], None  # slices, of which the last may go on in the next batch
        for pdf in batches:
            for key, part in pdf.groupby([*by, "slice"], sort=False, dropna=False):
                known = tuple(None if pd.isna(k) else k for k in key)
                if known != at:
                    if len(held) == SIDE_BY_SIDE:
                        yield from flush(held)
                        held = []
                    held.append(([], []))
                    at = known
                held[-1][0].append(np.array(part["shingle"].tolist(), float))
                held[-1][1].append(part.drop(columns=["shingle"]))
        if held:
            yield from flush(held)

    d = d.select(*by, "ts", "seq", "shingle", "idx", "slice", "own")
    # Slices are of one size: as many to each task, and as many rounds of tasks as it takes for forests to share their steps.
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = min(slices, cores * math.ceil(slices / (cores * SIDE_BY_SIDE)))
    dealt = d.repartitionByRange(tasks, *by, "slice").sortWithinPartitions(*by, "slice", "idx")
    return dealt.mapInPandas(run, f"{_keys(d, by)}, ts bigint, seq bigint, score double")


def rcf_score_transient(history: DataFrame, probes: DataFrame, by: list[str], *, trees: int = 50, size: int = 256, seed: int = 42) -> DataFrame:
    """Probes scored by forests of each key's last ``size`` rows, without learning.

    A key's probes are dealt to tasks, each of which grows the key's small forest and takes its probes through it together.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("seq"))
    last = history.withColumn("i", F.row_number().over(w)).where(F.col("i") <= size).select(*by, "i", "value")
    parts = probes.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / PROBES).cast("int").alias("parts"))
    mixed = F.xxhash64(*[c for c in ("ts", "seq", "value") if c in probes.columns])
    there = joined(probes.select(*[F.col(c).alias(c) for c in (*by, "value")], mixed.alias("h")), parts, by)
    there = there.select(*[F.col(c).alias(c) for c in (*by, "value")], F.pmod("h", F.col("parts")).cast("int").alias("part"))
    here = joined(last, parts, by).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        scorer = Scorer(trees, size, 1, seed, RESTART, len(a))
        scorer.warm(a.sort_values("i", ascending=False)["value"].to_numpy(float)[:, None])
        return b[by].assign(value=b["value"], score=scorer.forest.probe(b["value"].to_numpy(float)[:, None], len(a)))

    return here.groupBy(*by, "part").cogroup(there.groupBy(*by, "part")).applyInPandas(run, f"{_keys(probes, by)}, value double, score double")


def rcf_stream(df: DataFrame, by: list[str], *, trees: int = 50, size: int = 256, shingle_size: int = 1, seed: int = 42, restart: int = RESTART) -> DataFrame:
    """`rcf_scores` of a stream: the forest is the key's state, a micro-batch is taken in (ts, seq) order."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
    from pyspark.sql.types import BinaryType, StructField, StructType

    restart = max(restart, 8 * size)

    class Scores(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("forest", StructType([StructField("bytes", BinaryType())]))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            pdf = pd.concat([r[["ts", "seq", "value"]] for r in rows]).sort_values(["ts", "seq"], kind="stable")
            scorer, tail = pickle.loads(self.state.get()[0]) if self.state.exists() else (Scorer(trees, size, shingle_size, seed, restart), [])
            known = np.concatenate((tail, pdf["value"].to_numpy(float)))
            points = np.lib.stride_tricks.sliding_window_view(known, shingle_size) if len(known) >= shingle_size else np.zeros((0, shingle_size))
            scores = scorer.score_all(points)
            self.state.update((pickle.dumps((scorer, [*known[len(known) - min(len(known), shingle_size - 1) :]])),))
            out = pdf.iloc[len(pdf) - len(scores) :][["ts", "seq"]].assign(score=scores)
            for name, value in zip(reversed(by), reversed(key), strict=True):
                out.insert(0, name, value)
            yield out

        def close(self) -> None:
            pass

    schema = f"{_keys(df, by)}, ts bigint, seq bigint, score double"
    return df.groupBy(*by).transformWithStateInPandas(Scores(), outputStructType=schema, outputMode="append", timeMode="none")
