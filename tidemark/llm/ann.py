"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and residual codebooks are fitted on a bounded, deterministic sample
(``max_sample`` rows of the smallest id hashes); every valid row is indexed.  The number of cells grows with the
square root of the table: beyond what the sample can fit one by one, cells are sums of a coarse centroid and
a centroid of the residuals.  The number of
cells to probe is calibrated on the sample: queries of the sample probe ever more cells until
``target_recall`` of their true neighbours lie in them; a query whose cells hold too few rows probes on.

Rows are grouped by (cell, salt); a cell's rows are spread over as many salts as its count
asks for, so a hot cell never is one task.  Each query visits its probed cells.  In a group, distance
tables give asymmetric distances to all codes; the best ``rerank`` of each query are measured exactly (double
precision, original vectors).  A row's asymmetric distance less its own quantisation error bounds its distance from
below: all further rows whose bound does not exceed the k-th exact distance are measured too, so the best k that
go on are exact for the group, whatever the codes can tell apart.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another
length than most of the sample take no part, nor do rows with a null id; repeated ids are separate
candidates, a row is never a candidate of a query with its own id; fewer candidates than k are all
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize

MAX_SAMPLE = 20_000
GROUP_ROWS = 16_384
GROUP_QUERIES = 16_384
MAX_FINE = 256
QUERY_BLOCK = 64
TARGET_RECALL = 0.97
CODES = 256
BLOCK_FLOATS = 1 << 22
# Fixed value: relative room for rounding, far above that of double precision.
SLACK = 1e-9


@dataclass
class Index:
    """centroids (cells x d), codebooks (parts x codes x width), bounds of the parts, cells to probe."""

    centroids: np.ndarray
    books: list[np.ndarray]
    bounds: np.ndarray
    probes: int

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        step = max(1, BLOCK_FLOATS // len(self.centroids))
        return np.concatenate([_distances(x[i : i + step], self.centroids).argmin(axis=1) for i in range(0, len(x), step)])

    def visits(self, x: np.ndarray, sizes: np.ndarray, k: int) -> list[np.ndarray]:
        """The cells that each vector looks at: ``probes`` of them, and further ones until they hold more than k rows."""
        out = []
        step = max(1, BLOCK_FLOATS // len(self.centroids))
        for i in range(0, len(x), step):
            order = np.argsort(_distances(x[i : i + step], self.centroids), axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) <= k).sum(axis=1) + 1
            out += [o[: max(self.probes, n)] for o, n in zip(order, enough.tolist(), strict=True)]
        return out

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[cell]
        out = np.empty((len(x), len(self.books)), np.uint8)
        for p, book in enumerate(self.books):
            out[:, p] = _distances(rest[:, self.bounds[p] : self.bounds[p + 1]], book).argmin(axis=1)
        return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2.0 * (x @ c.T)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        used = n > 0
        centres[used] = sums[used] / n[used, None]
    return centres


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vec array<double> of the rows that take part (of any length)."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & sound & F.exists("vec", lambda v: v != 0))


def fit(vectors: DataFrame, *, cells: int | None = None, parts: int = 16, k: int = 10, max_sample: int = MAX_SAMPLE) -> Index | None:
    """Fit on a sample of ``valid_vectors``; None without rows."""
    n = vectors.count()
    share = min(1.0, max_sample / max(1, n))
    picked = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < max(1, int(share * 1_000_000)))
    rows = picked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).toArrow().column("vec").to_pylist()
    if not rows:
        rows = vectors.limit(1).toArrow().column("vec").to_pylist()
    if not rows:
        return None
    dim = min(Counter(map(len, rows)).items(), key=lambda x: (-x[1], x[0]))[0]
    x = np.array([r for r in rows if len(r) == dim], np.float32)
    wanted = cells or max(1, round(np.sqrt(n) / 2))
    coarse = min(wanted, max(1, len(x) // 40))
    centroids = _kmeans(x, coarse, 1)
    fine = min(MAX_FINE, -(-wanted // coarse))
    if fine > 1:
        near = _distances(x, centroids).argmin(axis=1)
        centroids = (centroids[:, None] + _kmeans(x - centroids[near], fine, 3)[None]).reshape(-1, dim)
    near = _distances(x, centroids).argmin(axis=1)
    rest = x - centroids[near]
    bounds = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
    books = [_kmeans(rest[:, a:b], CODES, 2 + a, 6) for a, b in zip(bounds, bounds[1:], strict=False)]
    asked = x[:256]
    d = _distances(asked, x)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    true = near[np.argsort(d, axis=1, kind="stable")[:, : min(k, max(1, len(x) - 1))]]
    order = np.argsort(_distances(asked, centroids), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(place, true, axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(TARGET_RECALL * len(needed))))]) + 1
    return Index(centroids, books, bounds, min(len(centroids), probes))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search_group(index: Index, k: int, rerank: int):
    def run(key: tuple, rows: pa.Table, asks: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        rows, asks = rows.combine_chunks(), asks.combine_chunks()
        if not rows.num_rows or not asks.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        exact = _matrix(rows.column("vec").chunk(0), index.dim)[order]
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        queries, who = _matrix(asks.column("vec").chunk(0), index.dim), asks.column("query_id").to_numpy()
        centre = index.centroids[int(asks.column("cell")[0].as_py())].astype(np.float64)
        books = [book.astype(np.float64) for book in index.books]
        coded = np.concatenate([book[codes[:, p]] for p, book in enumerate(books)], axis=1)
        error = np.sqrt(((exact - centre - coded) ** 2).sum(axis=1))
        norms = (exact * exact).sum(axis=1)
        out: list[list[np.ndarray]] = [[], [], []]
        for lo in range(0, len(who), QUERY_BLOCK):
            block = queries[lo : lo + QUERY_BLOCK]
            rest = block - centre
            approx = np.zeros((len(block), len(ids)))
            for p, book in enumerate(books):
                part = rest[:, index.bounds[p] : index.bounds[p + 1]]
                approx += ((part[:, None, :] - book[None]) ** 2).sum(axis=2)[:, codes[:, p]]
            squares = None
            for q in range(len(block)):
                near = approx[q]
                own = ids == who[lo + q]
                if own.any():
                    near = np.where(own, np.inf, near)
                m = min(rerank, len(ids))
                best = np.argpartition(near, m - 1)[:m]
                best = best[near[best] < np.inf]
                score = np.sqrt(((exact[best] - block[q]) ** 2).sum(axis=1))
                if m < len(ids):
                    kth = np.partition(score, k - 1)[k - 1] if len(score) >= k else np.inf
                    far = np.sqrt(near)
                    open_ = (far - error <= kth + SLACK * (far + error)) & (near < np.inf)
                    open_[best] = False
                    if open_.any():
                        if squares is None:  # one product for the block rules out most open rows
                            squares = norms - 2.0 * (block @ exact.T)
                        own_norm = (block[q] ** 2).sum()
                        more = np.flatnonzero(open_ & (squares[q] + own_norm <= kth**2 + SLACK * (norms + own_norm)))
                        best = np.concatenate((best, more))
                        score = np.concatenate((score, np.sqrt(((exact[more] - block[q]) ** 2).sum(axis=1))))
                top = np.lexsort((ids[best], score))[:k]
                out[0].append(np.full(len(top), who[lo + q], np.int64))
                out[1].append(ids[best][top])
                out[2].append(score[top])
        return pa.table([pa.array(np.concatenate(o), t) for o, t in zip(out, kinds, strict=True)], names=names)

    return run


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    rerank: int = 64,
    index: Index | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` whose id (``vec_id``) satisfies ``is_query``."""
    spark = vectors.sparkSession
    valid = valid_vectors(vectors, id_col, vector_col)
    index = index or fit(valid, k=k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)
    valid = valid.where(F.size("vec") == index.dim)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), shared.value.dim).astype(np.float32)
            cell = shared.value.cells(x)
            codes = shared.value.codes(x, cell)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary())],
                names=["vec_id", "vec", "cell", "codes"],
            )

    def visit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = shared.value.visits(_matrix(part.column(1), shared.value.dim).astype(np.float32), held.value, k)
                taken = part.take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(found), pa.int64())], names=["query_id", "vec", "cell"])

    indexed = materialize(valid.mapInArrow(assign, "vec_id long, vec array<double>, cell long, codes binary"), "indexed")
    sizes = indexed.groupBy("cell").count().collect()  # one row per cell
    filled = np.zeros(len(index.centroids), np.int64)
    for r in sizes:
        filled[r["cell"]] = r["count"]
    held = spark.sparkContext.broadcast(filled)
    salts = spark.createDataFrame(
        [(r["cell"], -(-r["count"] // GROUP_ROWS)) for r in sizes] or [(0, 1)], "cell long, salts long"
    )
    rows = indexed.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")))
    asks = valid.where(is_query).mapInArrow(visit, "query_id long, vec array<double>, cell long")
    # Queries of a cell are dealt to lots too: a group holds at most about GROUP_QUERIES of them beside GROUP_ROWS rows.
    asked = asks.groupBy("cell").count().collect()  # one row per cell
    lots = spark.createDataFrame([(r["cell"], -(-r["count"] // GROUP_QUERIES)) for r in asked] or [(0, 1)], "cell long, lots long")
    asks = asks.join(F.broadcast(lots), "cell").withColumn("lot", F.pmod(F.xxhash64("query_id"), F.col("lots"))).join(F.broadcast(salts), "cell")
    asks = asks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    rows = rows.join(F.broadcast(lots), "cell").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
    group = ["cell", "salt", "lot"]
    found = (
        rows.select(*group, "vec_id", "vec", "codes").groupBy(*group).cogroup(asks.select(*group, "query_id", "vec").groupBy(*group))
        .applyInArrow(lambda key, a, b: _search_group(shared.value, k, rerank)(key, a, b), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
