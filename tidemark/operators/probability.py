"""Probability and risk of keyed samples (by..., value)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import sliced
from tidemark.operators.ranks import quantiles
from tidemark.operators.sliced import largest


def ecdf(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of rows at or below each distinct value."""
    counted = df.where("value IS NOT NULL").groupBy(*by, "value").agg(F.count("*").alias("n"))
    return with_share(counted, by).select(*by, "value", "ecdf")


def with_share(counted: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``upto`` and ``ecdf`` to the distinct values (by..., value, n) of each key.

    Keys of more distinct values than a window may hold: running counts inside ranges of values, plus the counts of lower
    ranges; there are so many ranges that each holds about a fourth of that.
    """
    top = largest(counted, by)
    if top <= sliced.ROWS:
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        return counted.withColumn("upto", upto).withColumn("ecdf", upto / F.sum("n").over(Window.partitionBy(*by)))
    ranges = -(-4 * top // sliced.ROWS)
    cuts = counted.groupBy(*by).agg(F.percentile_approx("value", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), max(10_000, 10 * ranges)).alias("__cuts"), F.sum("n").alias("__all"))
    d = counted.join(cuts, by) if by else counted.crossJoin(F.broadcast(cuts))
    d = d.withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("value")))).drop("__cuts")
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*by, "__range").agg(F.sum("n").alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    inside = Window.partitionBy(*by, "__range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__in", F.sum("n").over(inside)).join(sums, [*by, "__range"])
    return d.withColumn("upto", F.col("__in") + F.col("__before")).withColumn("ecdf", F.col("upto") / F.col("__all")).drop("__in", "__before", "__range", "__all")


def exceedance(df: DataFrame, by: list[str], threshold: float) -> DataFrame:
    above = F.col("value") > threshold
    return df.where("value IS NOT NULL").groupBy(*by).agg(
        F.avg(above.cast("double")).alias("probability"), F.count_if(above).alias("above"), F.count("*").alias("n")
    )


def threshold_exceedance(df: DataFrame, by: list[str], thresholds: list[float]) -> DataFrame:
    """Exceedance of several thresholds in one pass."""
    g = df.where("value IS NOT NULL").groupBy(*by).agg(
        F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.avg((F.col("value") > t).cast("double")).alias("probability")) for t in thresholds]).alias("x")
    )
    return g.select(*by, F.explode("x").alias("x")).select(*by, "x.*")


# Two-sided standard normal quantiles.
Z = {0.8: 1.2815515655446004, 0.9: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def _t_quantile(z: float, nu: Column) -> Column:
    """Student quantile from the normal one (Cornish-Fisher in 1 / nu)."""
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return F.lit(z) + g[0] / nu + g[1] / nu**2 + g[2] / nu**3


def confidence_interval(df: DataFrame, by: list[str], level: float = 0.95, method: str = "t", *, resamples: int = 1000, seed: int = 42, row_key: list[str] | None = None) -> DataFrame:
    """Interval of the mean: t, normal, percentile (of the data) or bootstrap (Poisson weights, no resampling shuffle).

    ``row_key`` names the columns that tell rows apart for the bootstrap (all but maps); rows equal in them share their weights.
    """
    row_key = row_key or [f.name for f in df.schema if f.dataType.typeName() != "map"]
    d = df.where("value IS NOT NULL")
    tail = (1 - level) / 2
    if method == "percentile":
        return quantiles(d, by, {"low": tail, "high": 1 - tail}).join(d.groupBy(*by).agg(F.avg("value").alias("mean")), by)
    if method in ("t", "normal"):
        g = d.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
        q = F.lit(Z[level]) if method == "normal" else _t_quantile(Z[level], F.col("n") - 1)
        half = q * F.col("sd") / F.sqrt("n")
        return g.select(*by, "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))
    if method != "bootstrap":
        raise ValueError(f"unknown method {method!r}")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.select(*by).schema)

    def weigh(batches):
        """Poisson weights come from a hash of (row, resample, seed), so they don't depend on how rows are laid out."""
        sums: dict[tuple, np.ndarray] = {}
        salts = _mixed(np.arange(resamples, dtype=np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64)))
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(len(by))]
            names = list(zip(*cols, strict=True)) if cols else [()] * batch.num_rows
            place = {k: i for i, k in enumerate(dict.fromkeys(names))}
            codes = np.array([place[k] for k in names])
            hashes = batch.column(len(by)).to_numpy().astype(np.int64).view(np.uint64)
            values = batch.column(len(by) + 1).to_numpy()
            for lo in range(0, len(codes), 512):
                part = slice(lo, lo + 512)
                u = (_mixed(hashes[part, None] ^ salts[None]) >> np.uint64(11)).astype(np.float64) / (1 << 53)
                w = np.searchsorted(_POISSON, u, "right").astype(np.float64)
                member = (codes[part, None] == np.arange(len(place))[None]).astype(np.float64)
                tops, counts = (member * values[part, None]).T @ w, member.T @ w
                for key, i in place.items():
                    own = sums.setdefault(key, np.zeros((2, resamples)))
                    own += (tops[i], counts[i])
        for key, (s, n) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([k] * resamples) for k in key], pa.array(range(resamples), pa.int32()), pa.array(s), pa.array(n)],
                names=[*by, "b", "s", "n"],
            )

    parts = d.select(*by, F.xxhash64(*row_key), "value").mapInArrow(weigh, f"{keys + ', ' if keys else ''}b int, s double, n double")
    means = parts.groupBy(*by, "b").agg((F.sum("s") / F.sum("n")).alias("m"))
    return means.groupBy(*by).agg(F.avg("m").alias("mean"), F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))  # ``resamples`` rows a key


#: Distribution function of a Poisson variable of mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def conditional_probability(df: DataFrame, by: list[str], condition: Column, event: Column) -> DataFrame:
    n, c, both, e = F.count("*"), F.count_if(condition), F.count_if(condition & event), F.count_if(event)
    return df.groupBy(*by).agg(
        (both / n).alias("joint"), F.when(c > 0, both / c).otherwise(0.0).alias("conditional"), (c / n).alias("condition"), (e / n).alias("event")
    )


def tail_probability(df: DataFrame, by: list[str], q: float) -> DataFrame:
    at = quantiles(df, by, {"threshold": q})
    above = F.col("value") > F.col("threshold")
    return df.where("value IS NOT NULL").join(at, by).groupBy(*by, "threshold").agg(F.avg(above.cast("double")).alias("share"), F.avg(F.when(above, F.col("value"))).alias("mean_above"))


def value_at_risk(df: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    return quantiles(df, by, {"var": 1 - confidence})


def expected_shortfall(df: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    d = df.join(value_at_risk(df, by, confidence), by).where("value <= var")
    return d.groupBy(*by, "var").agg(F.avg("value").alias("shortfall"))


def density(df: DataFrame, by: list[str], points: int = 200, bins: int = 1024) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) on ``points`` positions, from fine bins instead of all rows."""
    from tidemark.operators.stats import histogram

    g = df.where("value IS NOT NULL").groupBy(*by).agg(F.stddev_samp("value").alias("sd"), F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    g = g.withColumn("bw", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))).where("bw > 0")
    h = histogram(df, by, bins).select(*by, ((F.col("low") + F.col("high")) / 2).alias("x"), F.col("count").alias("w"))
    grid = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    u = (F.col("at") - F.col("x")) / F.col("bw")
    kernel = F.col("w") * F.exp(-u * u / 2) / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))
    return grid.join(h, by).groupBy(*by, "i", "at").agg(F.sum(kernel).alias("density"))


def joint_density(df: DataFrame, by: list[str], x: str, y: str, bins: int = 20) -> DataFrame:
    """Two-dimensional histogram density with bin centres."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = d.groupBy(*by).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count("*").alias("n"))

    def place(c: str, lo: str, hi: str) -> Column:
        return F.when(F.col(hi) > F.col(lo), F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins))).otherwise(0)

    d = (d.join(ends, by) if by else d.crossJoin(F.broadcast(ends))).withColumn("bx", place(x, "x0", "x1")).withColumn("by_", place(y, "y0", "y1"))
    wx, wy = (F.col("x1") - F.col("x0")) / bins, (F.col("y1") - F.col("y0")) / bins
    g = d.groupBy(*by, "bx", "by_", "x0", "x1", "y0", "y1", "n").agg(F.count("*").alias("count"))
    return g.select(*by, (F.col("x0") + (F.col("bx") + 0.5) * wx).alias("x"), (F.col("y0") + (F.col("by_") + 0.5) * wy).alias("y"), "count", (F.col("count") / (F.col("n") * wx * wy)).alias("density"))
