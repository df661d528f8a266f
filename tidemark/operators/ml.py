"""Distributed machine learning over numeric columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, MinMaxScaler, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.components import connected_components
from tidemark.sources.scratch import materialize

SCALERS = {"standard": lambda: StandardScaler(withMean=True, withStd=True), "minmax": MinMaxScaler, "robust": lambda: RobustScaler(withCentering=True)}


def prepare(df: DataFrame, target: str | None, features: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Rows without nulls with a ``features`` vector (numeric columns by default) and a ``label``."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    features = features or [c for c, t in df.dtypes if (t in numeric or t.startswith("decimal")) and c != target]
    if not features:
        raise ValueError("no feature column")
    d = df.dropna(subset=[*features, *([target] if target else [])])
    d = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(d)
    return (d.withColumn("label", F.col(target).cast("double")) if target else d), features


def split(df: DataFrame, key: list[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test`` by a hash of the key: the same rows whatever the partitioning."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(10_000)) < int(test * 10_000))


def _equal_rows(d: DataFrame, names: list[str]) -> DataFrame:
    """One row for all rows of equal features: their mean ``label``, and ``copies``, their number.

    Trees that minimise squared errors are the same over these weighted rows: the spread of labels around the mean of
    equal rows is in every impurity above them, whatever the split, so gains and leaves don't change.
    """
    vector = F.array(*[F.col(f"`{c}`").cast("double") for c in names])
    g = d.groupBy(vector.alias("values")).agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("copies"))
    return g.select(array_to_vector("values").alias("features"), "label", "copies")


def scores(predicted: DataFrame) -> DataFrame:
    """r2, mse and mae of the train and test rows."""
    err = F.col("label") - F.col("prediction")
    g = predicted.groupBy("is_test").agg(F.count("*").alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.var_pop("label").alias("var"))
    return g.select("is_test", "n", "mse", "mae", F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).alias("r2"))


def regression(df: DataFrame, target: str, features: list[str], key: list[str], kind: str = "linear", *, alpha: float = 1.0, l1_ratio: float = 0.5, trees: int = 20, depth: int = 5):
    """(model, scores, coefficients or importances) of linear, ridge, lasso, elastic_net, random_forest or gradient_boosting."""
    d, names = prepare(df, target, features)
    d = split(d, key)
    train = d.where("NOT is_test")
    if kind in ("linear", "ridge", "lasso", "elastic_net"):
        n = max(1, train.count()) if kind == "ridge" else 1
        mix = {"linear": 0.0, "ridge": 0.0, "lasso": 1.0, "elastic_net": l1_ratio}[kind]
        reg = {"linear": 0.0, "ridge": alpha / n}.get(kind, alpha)
        est = LinearRegression(regParam=reg, elasticNetParam=mix, standardization=False)
    elif kind == "random_forest":
        est = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=42)
    elif kind == "gradient_boosting":
        est = GBTRegressor(maxIter=trees, maxDepth=depth, seed=42, weightCol="copies")
        train = _equal_rows(train, names)
    else:
        raise ValueError(f"unknown regression {kind!r}")
    model = est.fit(train)
    values = model.coefficients if kind in ("linear", "ridge", "lasso", "elastic_net") else model.featureImportances
    table = df.sparkSession.createDataFrame([(n_, float(v), abs(float(v)) > 1e-10) for n_, v in zip(names, values.toArray(), strict=True)], "feature string, weight double, selected boolean")
    return model, scores(model.transform(d)), table


def linear_weights(df: DataFrame, target: str, features: list[str], *, alpha: float = 0.0) -> DataFrame:
    """feature, weight of least squares over all rows without nulls (``alpha``: ridge penalty of the weights, not of the intercept).

    The normal equations come from one aggregate of means and covariances; only they are solved on the driver.
    """
    names = [*features, target]
    cols = [F.col(c).cast("double") for c in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).dropna().agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(names))], *[F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs]
    ).first()
    schema, k = "feature string, weight double", len(features)
    if not row["n"]:
        return df.sparkSession.createDataFrame([], schema)
    cov = np.array([[row[f"v{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)
    w = np.linalg.lstsq(cov[:k, :k] + np.eye(k) * alpha / row["n"], cov[:k, k], rcond=None)[0]
    intercept = row[f"m{k}"] - sum(a * row[f"m{i}"] for i, a in enumerate(w))
    return df.sparkSession.createDataFrame([*zip(features, map(float, w), strict=True), ("intercept", float(intercept))], schema)


def scaled(df: DataFrame, kind: str = "standard", column: str = "features", out: str = "scaled") -> DataFrame:
    if kind == "none":
        return df.withColumn(out, F.col(column))
    return SCALERS[kind]().setInputCol(column).setOutputCol(out).fit(df).transform(df)


def kmeans(df: DataFrame, features: list[str], k: int, *, scaler: str = "standard", seed: int = 42):
    """(labelled rows, centroids in original units, simplified silhouette, inertia)."""
    d, names = prepare(df, None, features)
    d = scaled(d, scaler)
    model = KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster").fit(d)
    out = model.transform(d)
    centroids = out.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names])
    silhouette = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster").evaluate(out)
    return out.drop("features", "scaled"), centroids, silhouette, model.summary.trainingCost


def pca(df: DataFrame, features: list[str], variance: float = 0.95):
    """(rows with components, explained ratios, loadings); as many components as the variance asks for."""
    d, names = prepare(df, None, features)
    d = scaled(d, "standard")
    model = PCA(k=len(names), inputCol="scaled", outputCol="all").fit(d)
    ratios = model.explainedVariance.toArray()
    k = int(min(len(names), np.searchsorted(np.cumsum(ratios), variance - 1e-12) + 1))
    rows = model.transform(d).withColumn("components", F.slice(vector_to_array("all"), 1, k)).drop("features", "scaled", "all")
    return rows, ratios[:k], model.pc.toArray()[:, :k]


def ica(df: DataFrame, features: list[str], *, max_iter: int = 100, tol: float = 1e-6, seed: int = 42):
    """(sources per row, mixing matrix) by FastICA: whitening and every step are sums of d x d numbers, added up in the tasks."""
    d, names = prepare(df, None, features)
    dim = len(names)

    def pack(batches):
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            ends = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (8 * dim))
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(x.tobytes())])], names=["x"])

    packed = d.select(*[F.col(c).cast("double") for c in names]).mapInArrow(pack, "x binary")
    m = materialize(packed, "components")  # read once a step: a row is one value, not dim of them

    def total(size: int, of) -> np.ndarray:
        """Sum over all rows of the ``size`` numbers that ``of`` finds for a block of rows; one array a task."""

        def part(batches):
            out = np.zeros(size)
            for b in batches:
                for at in range(0, b.num_rows, 1024):  # a block's arrays stay in the processor's cache
                    piece = b.column(0).slice(at, 1024)
                    first, last = np.frombuffer(piece.buffers()[1], np.int32)[[piece.offset, piece.offset + len(piece)]]
                    out += of(np.frombuffer(piece.buffers()[2], np.float64, (last - first) // 8, first).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(out)], names=["i", "v"])

        got = {r["i"]: r["v"] for r in m.mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        return np.array([got.get(i, 0.0) for i in range(size)])

    sums = total(dim + 1, lambda x: np.append(x.sum(axis=0), len(x)))
    n = sums[dim]
    if not n:
        raise ValueError("no row without nulls")
    mean = sums[:dim] / n
    cov = total(dim * dim, lambda x: ((x - mean).T @ (x - mean)).ravel()).reshape(dim, dim) / n
    val, vec = np.linalg.eigh(cov)
    white = (vec / np.sqrt(np.maximum(val, 1e-12))).T
    rng = np.random.default_rng(seed)

    def orthogonal(w: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(w)
        return u @ v

    w = orthogonal(rng.standard_normal((dim, dim)))
    for _ in range(max_iter):

        def step(x, shared=w):
            x = (x - mean) @ white.T
            y = np.tanh(x @ shared.T)
            return np.concatenate(((y.T @ x).ravel(), (1 - y * y).sum(axis=0)))

        v = total(dim * dim + dim, step) / n
        new = orthogonal(v[: dim * dim].reshape(dim, dim) - v[dim * dim :, None] * w)
        gap = np.max(np.abs(np.abs((new * w).sum(axis=1)) - 1))
        w = new
        if gap < tol:
            break
    unmix = w @ white

    @F.pandas_udf("array<double>")
    def sources(*cols: pd.Series) -> pd.Series:
        return pd.Series(list((np.column_stack([c.to_numpy(float) for c in cols]) - mean) @ unmix.T))

    return d.drop("features").withColumn("sources", sources(*[F.col(c).cast("double") for c in names])), np.linalg.pinv(unmix)


def _tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list:
    if limit == 0 or len(x) <= 1:
        return [len(x)]
    span = x.max(axis=0) - x.min(axis=0)
    wide = np.flatnonzero(span > 0)
    if not len(wide):
        return [len(x)]
    f = int(rng.choice(wide))
    at = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    low = x[:, f] < at
    return [f, at, _tree(x[low], rng, limit - 1), _tree(x[~low], rng, limit - 1)]


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _depths(tree: list, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    stack = [(tree, np.arange(len(x)), 0)]
    while stack:
        node, rows, depth = stack.pop()
        if len(node) == 1:
            out[rows] = depth + _average_path(node[0])
            continue
        low = x[rows, node[0]] < node[1]
        stack += [(node[2], rows[low], depth + 1), (node[3], rows[~low], depth + 1)]
    return out


def isolation_forest(df: DataFrame, features: list[str], key: list[str], *, contamination: float = 0.01, trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """Adds score (near 1: isolated) and anomaly; trees grow from bounded samples, all rows are scored in batches."""
    d = df.dropna(subset=features)
    n = max(1, d.count())
    share = min(1.0, trees * sample * 1.2 / n)
    h = F.xxhash64(F.lit(seed), *key)
    picked = d.where(F.pmod(h, F.lit(1_000_000)) < max(1, int(share * 1_000_000))).select(*[F.col(c).cast("double") for c in features], h.alias("h"))
    rows = picked.orderBy("h").limit(int(trees * sample * 1.5)).toPandas()[features].to_numpy()
    rng = np.random.default_rng(seed)
    forest = [_tree(rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)], rng, int(np.ceil(np.log2(max(2, sample))))) for _ in range(trees)] if len(rows) else []
    shared = df.sparkSession.sparkContext.broadcast(forest)
    unit = _average_path(min(sample, max(2, len(rows))))

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        return pd.Series(2.0 ** (-np.mean([_depths(t, x) for t in shared.value], axis=0) / unit))

    out = d.withColumn("score", score(*[F.col(c).cast("double") for c in features]))
    bar = out.agg(F.approx_percentile("score", 1 - contamination, 10_000).alias("bar"))
    return out.crossJoin(F.broadcast(bar)).withColumn("anomaly", F.col("score") > F.col("bar")).drop("bar")


def dbscan(df: DataFrame, x: str, y: str, key: str, *, eps: float, min_samples: int) -> DataFrame:
    """Clusters of a plane (-1: noise); points meet through eps-cells; cluster ids are the least core key.

    Equal points are one with a weight, so that copies of a table don't meet each other.
    A cell of edge eps / sqrt(2) with at least ``min_samples`` points is all core and connected, so its points are joined
    through the cell, not in pairs; only cells are compared with each other's points.
    """
    edge = eps / 2**0.5
    rows = df.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    rows = materialize(rows, "plane")
    p = rows.groupBy("x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
    p = p.withColumn("cx", F.floor(F.col("x") / edge)).withColumn("cy", F.floor(F.col("y") / edge))
    p = materialize(p, "points")
    size = p.groupBy("cx", "cy").agg(F.sum("w").alias("size"))
    p = materialize(p.join(size, ["cx", "cy"]), "sized")
    near = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near])
    thin = p.where(F.col("size") < min_samples).withColumn("s", F.explode(steps))
    q = p.select(F.col("w").alias("qw"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    close = (F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2 <= eps * eps
    met = thin.join(q, (F.col("cx") + F.col("s.i") == F.col("nx")) & (F.col("cy") + F.col("s.j") == F.col("ny"))).where(close)
    sparse_core = met.groupBy("id").agg(F.sum("qw").alias("n")).where(F.col("n") >= min_samples).select("id")
    core = materialize(p.where(F.col("size") >= min_samples).unionByName(p.join(sparse_core, "id", "left_semi")), "core")
    cells = core.groupBy("cx", "cy").agg(F.min("id").alias("root"))
    pts = core.select("id", "x", "y", "cx", "cy")
    other = pts.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    links = (
        pts.withColumn("s", F.explode(steps)).where("s.i > 0 OR (s.i = 0 AND s.j > 0)")
        .join(other, (F.col("cx") + F.col("s.i") == F.col("nx")) & (F.col("cy") + F.col("s.j") == F.col("ny"))).where(close)
        .select("cx", "cy", "nx", "ny").distinct()
    )
    here, there = cells.withColumnRenamed("root", "src"), cells.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("root").alias("dst"))
    found = connected_components(links.join(here, ["cx", "cy"]).join(there, ["nx", "ny"]).select("src", "dst"))
    state = cells.join(found, F.col("root") == F.col("node"), "left").select("cx", "cy", F.coalesce("component", "root").alias("root"))
    labelled = core.join(state, ["cx", "cy"]).select("id", F.col("root").alias("cluster"), "x", "y", "cx", "cy")
    rest = p.join(core.select("id"), "id", "left_anti").withColumn("s", F.explode(steps))
    c = labelled.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("cx").alias("nx"), F.col("cy").alias("ny"), "cluster")
    border = rest.join(c, (F.col("cx") + F.col("s.i") == F.col("nx")) & (F.col("cy") + F.col("s.j") == F.col("ny"))).where(close).groupBy("id").agg(F.min("cluster").alias("cluster"))
    found = labelled.select("id", "cluster", F.lit(True).alias("core")).unionByName(border.select("id", "cluster", F.lit(False).alias("core")))
    labels = p.select("x", "y", "id").join(found, "id", "left").select("x", "y", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))
    return rows.join(labels, ["x", "y"]).select(F.col("id").alias(key), "cluster", "core")
