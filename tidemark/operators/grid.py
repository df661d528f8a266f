"""Value grids and state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sliced import fits, with_lag, with_running
from tidemark.sources.scratch import materialize

#: Moves that one plan may nest.
PLAIN_STEPS = 8


def grid_fit(
    df: DataFrame,
    by: list[str],
    *,
    lo: str = "gmin",
    hi: str = "gmax",
    max_bit: int = 12,
    delta_multiplier: float = 1.3,
    min_abs_delta: float = 0.02,
    min_step_frac: float | None = None,
) -> DataFrame:
    """The finest grid of 2**level cells on [lo, hi] before crossings grow too fast.

    Values are quantised once to 2**max_bit cells and coarsened by shifts, so all levels come from
    one pass.  Level 2 and above stop where the growth of crossings a segment (pair of consecutive points) exceeds the last growth times
    ``delta_multiplier``, is at least ``min_abs_delta`` and the last growth is positive; any level
    stops where the step falls below ``min_step_frac`` of the range's middle.  ``level`` is the level kept,
    ``max_bit`` the finest one that was allowed.
    """
    top = (1 << max_bit) - 1
    width = F.col(hi) - F.col(lo)
    cell = F.when(width > 0, F.greatest(F.lit(0), F.least(F.lit(top), F.floor((F.col("value") - F.col(lo)) / width * (top + 1))))).cast("long")
    d = with_lag(df.where("value IS NOT NULL").withColumn("cell", cell), by, {"before": "cell"})
    levels = range(max_bit + 1)
    crossings = [
        F.coalesce(F.sum(F.abs(F.shiftright("cell", max_bit - i) - F.shiftright("before", max_bit - i))), F.lit(0)).cast("double").alias(f"x{i}")
        for i in levels
    ]
    g = d.groupBy(*by).agg(F.min(lo).alias("gmin"), F.max(hi).alias("gmax"), F.greatest(F.count("*") - 1, F.lit(1)).alias("segments"), *crossings)
    span = F.col("gmax") - F.col("gmin")
    start = F.struct(F.lit(0).alias("level"), F.lit(0.0).alias("growth"), F.lit(False).alias("stop"), F.lit(0.0).alias("last"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x")) for i in levels])

    def fold(acc: Column, s: Column) -> Column:
        growth = (s["x"] - acc["last"]) / F.col("segments")
        sharp = (s["i"] >= 2) & (growth > acc["growth"] * delta_multiplier) & (growth >= min_abs_delta) & (acc["growth"] > 0)
        fine = F.lit(False)
        if min_step_frac is not None:
            fine = span / F.pow(F.lit(2.0), s["i"]) < min_step_frac * (F.col("gmin") + F.col("gmax")) / 2
        stop = acc["stop"] | sharp | fine
        return F.struct(
            F.when(stop, acc["level"]).otherwise(s["i"]).alias("level"),
            F.when(stop, acc["growth"]).otherwise(growth).alias("growth"),
            stop.alias("stop"),
            F.when(stop, acc["last"]).otherwise(s["x"]).alias("last"),
        )

    level = F.aggregate(steps, start, fold)["level"]
    g = g.withColumn("level", level)
    step = F.when(span > 0, span / F.pow(F.lit(2.0), F.col("level"))).otherwise(1.0)
    return g.select(*by, step.alias("step"), F.col("gmin").alias("offset"), "gmin", "gmax", F.col("level").cast("int").alias("level"), F.lit(max_bit).alias("max_bit")).withColumn(
        "num_cells", num_cells().cast("int")
    )


def fit_values(df: DataFrame, by: list[str], **options) -> DataFrame:
    """``grid_fit`` on each key's own range."""
    ends = df.groupBy(*by).agg(F.min("value").alias("gmin"), F.max("value").alias("gmax"))
    return grid_fit(df.join(ends, by), by, **options)


def _on_grid(df: DataFrame, by: list[str], grid: DataFrame) -> DataFrame:
    """Rows with their key's grid; the grid's columns win over equal names."""
    return df.drop(*[c for c in grid.columns if c not in by]).join(grid, by)


def num_cells() -> Column:
    return F.greatest(F.lit(1), F.ceil((F.col("gmax") - F.col("offset")) / F.col("step")))


def cell_of(value: Column) -> Column:
    """Cell of a value: 0 at or below the minimum, the last at or above the maximum."""
    return (
        F.when(value <= F.col("gmin"), 0)
        .when(value >= F.col("gmax"), num_cells() - 1)
        .otherwise(F.floor((value - F.col("offset")) / F.col("step")))
        .cast("long")
    )


def crossings(df: DataFrame, by: list[str], grid: DataFrame) -> DataFrame:
    """Cells crossed between consecutive points."""
    d = with_lag(_on_grid(df, by, grid).withColumn("cell", cell_of(F.col("value"))), by, {"before": "cell"})
    return d.groupBy(*by).agg(F.coalesce(F.sum(F.abs(F.col("cell") - F.col("before"))), F.lit(0)).cast("long").alias("crossings"))


def occupancy(df: DataFrame, by: list[str], grid: DataFrame, interval_secs: int) -> DataFrame:
    """Points per (time bucket from the key's first ts, cell)."""
    start = df.groupBy(*by).agg(F.min("ts").alias("t0"))
    d = _on_grid(df.join(start, by), by, grid)
    bucket = F.floor((F.col("ts") - F.col("t0")) / interval_secs).cast("long")
    return d.groupBy(*by, bucket.alias("bucket"), cell_of(F.col("value")).alias("cell")).agg(F.count("*").alias("n"))


def ranges(grid: DataFrame, by: list[str]) -> DataFrame:
    """Index and edges of every cell."""
    d = grid.select(*by, "step", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_cells").cast("long") - 1)).alias("cell"))
    low = F.col("offset") + F.col("cell") * F.col("step")
    return d.select(*by, "cell", low.alias("low"), (low + F.col("step")).alias("high"))


def dominant_cells(df: DataFrame, by: list[str], grid: DataFrame, interval_secs: int, *, empty_bucket: str = "top") -> DataFrame:
    """The most occupied cell of each bucket; ties: the highest. An empty bucket counts as the top cell, or is skipped."""
    occ = occupancy(df, by, grid, interval_secs)
    top = occ.groupBy(*by, "bucket").agg(F.max_by("cell", F.struct("n", "cell")).alias("cell"))
    if empty_bucket == "skip":
        return top
    ends = top.groupBy(*by).agg(F.max("bucket").alias("hi"))
    spine = ends.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), "hi")).alias("bucket"))
    full = spine.join(top, [*by, "bucket"], "left").join(grid.select(*by, "num_cells"), by)
    return full.select(*by, "bucket", F.coalesce("cell", F.col("num_cells").cast("long") - 1).alias("cell"))


def transitions(dominant: DataFrame, by: list[str]) -> DataFrame:
    """Counts of moves between the dominant cells of consecutive buckets."""
    d = with_lag(dominant.withColumnRenamed("bucket", "ts").withColumn("seq", F.lit(0)), by, {"from": "cell"})
    return d.where("`from` IS NOT NULL").groupBy(*by, "from", F.col("cell").alias("to")).agg(F.count("*").alias("n"))


def move_probabilities(moves: DataFrame, by: list[str], *, per_cell: bool = False) -> DataFrame:
    """Shares of moves up, down and nowhere: per key, or per cell that is left."""
    keys = [*by, "from"] if per_cell else by
    total = F.sum("n")

    def part(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))) / total, F.lit(0.0))

    return moves.groupBy(*keys).agg(
        part(F.col("to") > F.col("from")).alias("up"), part(F.col("to") < F.col("from")).alias("down"),
        part(F.col("to") == F.col("from")).alias("stay"), total.alias("moves"),
    )


def dwell_times(dominant: DataFrame, by: list[str]) -> DataFrame:
    """Lengths of the runs of equal dominant cells."""
    d = dominant.withColumnsRenamed({"bucket": "ts"}).withColumn("seq", F.lit(0))
    whole = fits(d, by)
    d = with_lag(d, by, {"before": "cell"}, whole=whole)
    d = with_running(d, by, {"run": (F.col("before").isNull() | (F.col("before") != F.col("cell"))).cast("long")}, whole=whole)
    return d.groupBy(*by, "run").agg(F.min("cell").alias("cell"), F.min("ts").alias("start"), F.count("*").alias("dwell"))


def dwell_summary(dominant: DataFrame, by: list[str]) -> DataFrame:
    return dwell_times(dominant, by).groupBy(*by, "cell").agg(F.avg("dwell").alias("mean_dwell"), F.max("dwell").alias("max_dwell"))


def n_step(moves: DataFrame, by: list[str], start: DataFrame, n: int) -> DataFrame:
    """Distribution over cells after ``n`` moves from ``start(by..., cell)``; a cell never left keeps its mass.

    Up to ``PLAIN_STEPS`` moves the state vector is carried from step to step in one plan; for more, the table of moves is squared as
    often as n has binary digits, each square being written to cut the lineage, and the vector takes the squares that n asks for.
    """
    out = moves.groupBy(*by, "from").agg(F.sum("n").alias("all"))
    p = moves.join(out, [*by, "from"]).select(*by, "from", "to", (F.col("n") / F.col("all")).alias("p"))
    state = start.withColumn("mass", F.lit(1.0))

    def moved(state: DataFrame, p: DataFrame) -> DataFrame:
        d = state.withColumnRenamed("cell", "from").join(p, [*by, "from"], "left")
        return d.groupBy(*by, F.coalesce("to", "from").alias("cell")).agg(F.sum(F.col("mass") * F.coalesce("p", F.lit(1.0))).alias("mass"))

    if n <= PLAIN_STEPS:
        for _ in range(n):
            state = moved(state, p)
        return state
    # Cells that are reached but never left go on to themselves.
    ends = p.select(*by, F.col("to").alias("from")).distinct().join(p.select(*by, "from").distinct(), [*by, "from"], "left_anti")
    p = materialize(p.unionByName(ends.select(*by, "from", F.col("from").alias("to"), F.lit(1.0).alias("p"))), "moves")
    while True:
        if n & 1:
            state = materialize(moved(state, p), "state")
        n >>= 1
        if not n:
            return state
        second = p.select(*by, F.col("from").alias("to"), F.col("to").alias("last"), F.col("p").alias("q"))
        p = materialize(p.join(second, [*by, "to"]).groupBy(*by, "from", F.col("last").alias("to")).agg(F.sum(F.col("p") * F.col("q")).alias("p")), "moves")


def absorption(moves: DataFrame, by: list[str], start: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """Chance of having reached the bottom or top cell of ``ends(by..., bottom, top)`` within ``n`` moves."""
    inner = moves.join(ends, by).where("`from` <> bottom AND `from` <> top").select(*moves.columns)
    state = n_step(inner, by, start, n).join(ends, by)
    return state.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("cell") == F.col("top"), F.col("mass"))), F.lit(0.0)).alias("top"),
        F.coalesce(F.sum(F.when(F.col("cell") == F.col("bottom"), F.col("mass"))), F.lit(0.0)).alias("bottom"),
    )


def efficiency_ratio(df: DataFrame, by: list[str]) -> DataFrame:
    """|net| / sum |change| and net / sum |change|; 0 below three points or without movement."""
    d = with_lag(df.where("value IS NOT NULL"), by, {"before": "value"})
    change = F.col("value") - F.col("before")
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(change).alias("net"), F.sum(F.abs(change)).alias("path"))
    ok = (F.col("n") >= 3) & (F.col("path") > 0)
    return g.select(
        *by, F.when(ok, F.abs("net") / F.col("path")).otherwise(0.0).alias("efficiency"),
        F.when(ok, F.col("net") / F.col("path")).otherwise(0.0).alias("slope_ratio"),
    )


def state_metrics(df: DataFrame, by: list[str], fitted: DataFrame, interval_secs: int) -> DataFrame:
    """Scalar metrics of a grid and its moves, one row each: (by..., metric, value)."""
    moves = move_probabilities(transitions(dominant_cells(df, by, fitted, interval_secs), by), by)
    last = df.groupBy(*by).agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
    d = last.join(fitted, by).join(moves, by, "left")
    metrics = {
        "grid_cells": F.col("num_cells"), "grid_step_price": F.col("step"), "grid_cell_now": cell_of(F.col("value")), "grid_lo": F.col("gmin"), "grid_hi": F.col("gmax"),
        "grid_up_prob": F.coalesce("up", F.lit(0.0)), "grid_down_prob": F.coalesce("down", F.lit(0.0)), "grid_stay_prob": F.coalesce("stay", F.lit(0.0)),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in metrics.items()])
    return d.select(*by, F.explode(pairs).alias("x")).select(*by, F.col("x.metric").alias("metric"), F.col("x.value").alias("value"))
