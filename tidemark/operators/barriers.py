"""First touch of a lower or an upper barrier, for any number of positions and parameter sets.

Bars are cut into blocks.  In a task a block's bars are arrays with running extremes over 1, 2, 4, ... bars: a position jumps over
every stretch that touches neither barrier, so each takes as many steps as the block's size has binary digits.  Positions that a block
doesn't close look for the first later block that will - the same search over the blocks' extremes - and then inside that one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sliced import largest
from tidemark.sources.scratch import materialize

#: Bars of a block, and positions that one task takes with it.
BLOCK_BARS = 65_536
GROUP_POSITIONS = 500_000


class Extremes:
    """Running lows and highs over stretches of bars."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high, self.n = [low], [high], len(low)
        while 2 ** len(self.low) <= self.n:
            half = 2 ** (len(self.low) - 1)
            self.low.append(np.minimum(self.low[-1][:-half], self.low[-1][half:]))
            self.high.append(np.maximum(self.high[-1][:-half], self.high[-1][half:]))

    def first(self, start: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
        """Place of the first bar from ``start`` on with low <= below or high >= above; n without one."""
        at = np.minimum(start, self.n).astype(np.int64)
        for k in reversed(range(len(self.low))):
            size = 2**k
            can = at + size <= self.n
            here = np.minimum(at, len(self.low[k]) - 1)
            free = can & ~((self.low[k][here] <= below) | (self.high[k][here] >= above))
            at = np.where(free, at + size, at)
        return at


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)


def _meet(d: DataFrame, bars: DataFrame, by: list[str]) -> DataFrame:
    """Positions with ``hit``: the first bar of their own block that touches a barrier (null without one)."""
    names = d.columns

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("bar")
        numbers = b["bar"].to_numpy(np.int64)
        hit = pd.array([pd.NA] * len(a), dtype="Int64")
        if len(b) and len(a):
            at = Extremes(b["l"].to_numpy(float), b["h"].to_numpy(float)).first(
                np.searchsorted(numbers, a["start"].to_numpy(np.int64)), a["below"].fillna(-np.inf).to_numpy(float), a["above"].fillna(np.inf).to_numpy(float)
            )
            hit[at < len(b)] = numbers[at[at < len(b)]]
        return a[names].assign(hit=hit)

    on = [*by, "block"]
    if largest(d, on) > GROUP_POSITIONS:
        counts = d.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / GROUP_POSITIONS).cast("int").alias("parts"))
        bars = bars.join(counts, on).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        d = d.join(counts, on).withColumn("part", F.pmod(F.xxhash64(*names), F.col("parts")).cast("int")).drop("parts")
        on = [*on, "part"]
    return d.groupBy(*on).cogroup(bars.groupBy(*on)).applyInPandas(run, f"{_schema(d, names)}, hit bigint")


def first_touch(d: DataFrame, bars: DataFrame, by: list[str], *, block: int | None = None) -> DataFrame:
    """Adds ``hit`` to positions (by..., start, below, above, ...): the first ``bar`` from ``start`` on with l <= below or h >= above.

    Null barriers are never touched; ``bars`` has by..., bar (whole numbers), h, l.
    """
    block = block or BLOCK_BARS
    columns = d.columns
    of = lambda c: F.floor(F.col(c) / block).cast("bigint")
    bars = bars.select(*by, F.col("bar").cast("bigint").alias("bar"), "h", "l").withColumn("block", of("bar"))
    ends = bars.agg(F.min("block").alias("lo"), F.max("block").alias("hi")).first()
    if ends["lo"] is None:
        return d.withColumn("hit", F.lit(None).cast("bigint"))
    placed = d.withColumn("start", F.greatest(F.col("start").cast("bigint"), F.lit(ends["lo"] * block))).withColumn("block", of("start"))
    if ends["lo"] == ends["hi"]:
        return _meet(placed, bars, by).select(*columns, "hit")
    met = materialize(_meet(placed, bars, by), "touched")
    open_ = met.where("hit IS NULL").drop("hit")
    closed = met.where("hit IS NOT NULL").select(*columns, "hit")
    blocks = bars.groupBy(*by, "block").agg(F.max("h").alias("h"), F.min("l").alias("l")).withColumnRenamed("block", "bar")
    blocks = materialize(blocks, "bar-blocks")
    onward = open_.withColumn("own", F.col("start")).withColumn("start", F.col("block") + 1).drop("block")
    ahead = materialize(first_touch(onward, blocks, by, block=block), "touched-blocks")
    never = ahead.where("hit IS NULL").withColumn("start", F.col("own")).select(*columns, "hit")
    later = ahead.where("hit IS NOT NULL").withColumn("block", F.col("hit")).withColumn("start", F.col("hit") * block).drop("hit")
    found = _meet(later, bars, by).withColumn("start", F.col("own")).select(*columns, "hit")
    return closed.unionByName(found).unionByName(never)
