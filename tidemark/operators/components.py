"""Connected components by alternating large-star and small-star joins.

Every round keeps at most as many links as there were before, tables are cut by Parquet
files in the shared folder, and hot nodes meet their minimum by an ordinary equi-join
that adaptive execution can split.  Nothing is collected but one count and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize


def _toward_minimum(sym: DataFrame, up: bool) -> DataFrame:
    """Link neighbours to the least node of each neighbourhood; ``up``: only larger neighbours move."""
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    met = sym.join(least.hint("merge"), F.col("u") == F.col("k"))  # Parquet packs ids so tightly that a table too large to broadcast looks small
    if up:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("k").alias("u"), F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(src, dst)``; component is the least node reachable.

    Rounds go on until nothing changes; their number grows with the logarithm of the longest path.
    """
    links = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    links = materialize(links, "links")
    mark = None
    while True:
        sym = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minimum(sym, up=True)
        links = materialize(_toward_minimum(large, up=False), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
