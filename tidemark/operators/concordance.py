"""Kendall's tau without comparing pairs of rows.

Rows are counted as distinct (x, y) and numbered by rank.  Discordant pairs are inversions of the y ranks in x order.  The plane of ranks is cut
into strips of bounded size along x, and into others along y.  Two points in different strips both ways are counted from
the number of points in each crossing of strips; two points that share a strip are counted inside it, by the bits of
their ranks; what shares both strips was counted twice and is taken off.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import sliced
from tidemark.operators.probability import with_share
from tidemark.operators.sliced import with_slices


def inversions(ranks: np.ndarray, weights: np.ndarray) -> float:
    """Sum of w_i w_j over i < j with rank_i > rank_j.

    From the top bit on: among ranks equal above a bit, every one before a zero is an inversion.
    """
    ranks, weights = np.unique(ranks, return_inverse=True)[1].astype(np.int64), weights.astype(float)
    total = 0.0
    for bit in reversed(range(int(ranks.max(initial=0)).bit_length())):
        one = (ranks >> bit & 1).astype(bool)
        above = ranks >> (bit + 1)
        upto = np.cumsum(np.where(one, weights, 0.0))
        first = np.flatnonzero(np.diff(above, prepend=-1))
        before = np.repeat(np.concatenate(([0.0], upto))[first], np.diff(first, append=len(ranks)))
        total += float((weights * (upto - before))[~one].sum())
        order = np.argsort(ranks >> bit, kind="stable")
        ranks, weights = ranks[order], weights[order]
    return total


def _inside(d: DataFrame, strips: list[str]) -> DataFrame:
    """Inversions among the points of each strip, or of each crossing of strips."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["xr", "yr"])
        return pd.DataFrame({"s": [inversions(pdf["yr"].to_numpy(), pdf["w"].to_numpy())]})

    return d.select(*strips, "xr", "yr", "w").groupBy(*strips).applyInPandas(run, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))


def _numbered(d: DataFrame, of: str, name: str) -> DataFrame:
    """The strips as numbers in their order; there are as many as rows by ``sliced.ROWS``."""
    strips = d.groupBy(of).agg(F.count(F.lit(1))).select(of, F.row_number().over(Window.orderBy(of)).cast("long").alias(name))
    return d.join(strips, of).drop(of)


def kendall_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, tau (tau-b) over the rows where both are not null; null where one of them doesn't vary."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    points = d.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    ties = []
    for c in ("x", "y"):
        counted = points.groupBy(F.col(c).alias("value")).agg(F.sum("w").alias("n"))
        ties.append(counted.agg(F.coalesce(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.lit(0.0)).alias(f"t{c}")))
        ranks = with_share(counted, []).select(F.col("value").alias(c), F.col("upto").cast("long").alias(f"{c}r"))
        points = points.join(ranks, c)
    points = points.select("xr", "yr", "w")
    whole = points.agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("w").cast("double") * (F.col("w") - 1) / 2), F.lit(0.0)).alias("txy"), F.count(F.lit(1)).alias("points")
    )
    if whole.first()["points"] <= sliced.ROWS:
        discordant = _inside(points.withColumn("a", F.lit(0)), ["a"])
    else:
        d = with_slices(points, [], ts="xr", seq="yr").withColumnRenamed("__slice", "__a")
        d = _numbered(with_slices(d, [], ts="yr", seq="xr").withColumnRenamed("__slice", "__b"), "__a", "a")
        d = _numbered(d, "__b", "b")
        cells = d.groupBy("a", "b").agg(F.sum("w").cast("double").alias("w"))
        # For each crossing: points in strips before a, and of them those in strips after b.
        grid = cells.select("a").distinct().crossJoin(cells.select("b").distinct()).join(cells, ["a", "b"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        left = F.coalesce(F.sum("w").over(Window.partitionBy("b").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        over = F.coalesce(F.sum("left").over(Window.partitionBy("a").orderBy("b").rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
        crossing = grid.withColumn("left", left).withColumn("over", over).agg(F.sum(F.col("w") * F.col("over")).alias("s"))
        parts = [crossing, _inside(d, ["a"]), _inside(d, ["b"]), _inside(d, ["a", "b"]).select((-F.col("s")).alias("s"))]
        discordant = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).agg(F.sum("s").alias("s"))
    all_ = whole.crossJoin(ties[0]).crossJoin(ties[1]).crossJoin(discordant)  # single rows
    pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    concordant = pairs - F.col("tx") - F.col("ty") + F.col("txy") - F.col("s")
    spread = F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))
    return all_.select("n", F.when(spread > 0, (concordant - F.col("s")) / spread).alias("tau"))
