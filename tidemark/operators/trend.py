"""Linear trend, capacity forecast and as-of verification of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import grid as G
from tidemark.operators.ranks import quantiles
from tidemark.sources.scratch import materialize

TINY = 1e-12


def trend_fit(
    df: DataFrame, by: list[str], *, min_samples: int = 8, amplitude_quantile: float = 0.95, significance: float = 2.0, min_amplitude: float = 0.0
) -> DataFrame:
    """Least squares on seconds since the first finite point, and the residuals' spread.

    Keys with fewer than max(min_samples, 2) points, no time span or no variance of time are left out.
    What a key's rows meet is written first: by its size Spark sees whether it may go to the rows instead of a key's rows to one task.
    """
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    d = df.where(ok).select(*by, "ts", "seq", "value")
    ends = materialize(d.groupBy(*by).agg(F.min("ts").alias("origin_ts")), "origins")
    d = d.join(ends, by).withColumn("x", (F.col("ts") - F.col("origin_ts")).cast("double"))
    g = d.groupBy(*by).agg(
        F.count("*").alias("samples"), F.max("x").alias("span"), F.max("ts").alias("anchor_ts"), F.min("origin_ts").alias("origin_ts"),
        F.max_by("value", F.struct("ts", "seq")).alias("current"), F.avg("value").alias("mean"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("offset"), F.regr_sxx("value", "x").alias("sxx"),
    )
    g = materialize(g.where((F.col("samples") >= max(min_samples, 2)) & (F.col("span") > 0) & (F.col("sxx") > TINY)), "lines")
    r = d.drop("origin_ts").join(g, by).withColumn("res", F.col("value") - (F.col("offset") + F.col("slope") * F.col("x")))
    spread = r.groupBy(*by).agg(
        F.sum(F.col("res") * F.col("res")).alias("sse"), F.sum((F.col("value") - F.col("mean")) ** 2).alias("sst")
    )
    g = g.join(spread, by).join(quantiles(r, by, {"amp": amplitude_quantile}, F.abs("res")), by)
    amplitude = F.greatest(F.col("amp"), F.lit(float(min_amplitude)))
    move = F.col("slope") * F.col("span")
    direction = F.when(F.abs(move) <= significance * amplitude, "flat").when(F.col("slope") > 0, "rising").otherwise("falling")
    return g.select(
        *by, "samples", "span", "origin_ts", "anchor_ts", "current", "slope", (F.col("slope") * 3600).alias("slope_hour"),
        (F.col("slope") * 86_400).alias("slope_day"), "offset",
        F.when(F.col("sst") > TINY, 1 - F.col("sse") / F.col("sst")).otherwise(0.0).alias("r2"),
        F.sqrt(F.col("sse") / F.greatest(F.col("samples") - 2, F.lit(1))).alias("residual_std"),
        amplitude.alias("amplitude"), (amplitude / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))).alias("amplitude_rel"), direction.alias("direction"),
    )


def value_at(ts: Column) -> Column:
    return F.col("offset") + F.col("slope") * (ts - F.col("origin_ts"))


def project(trend: DataFrame, by: list[str], hours: list[float]) -> DataFrame:
    """Trend and its envelope ``hours`` after the last observation; hours that aren't finite count as 0."""
    import math

    finite = [h if math.isfinite(h) else 0.0 for h in hours]
    d = trend.withColumn("hours", F.explode(F.array(*[F.lit(float(h)) for h in finite])))
    mid = value_at(F.col("anchor_ts") + F.col("hours") * 3600)
    return d.select(*by, "hours", mid.alias("value"), (mid - F.col("amplitude")).alias("low"), (mid + F.col("amplitude")).alias("high"))


def hours_to(target: Column, upper: bool = False) -> Column:
    """Hours until the trend (or its upper envelope) reaches a target; only while rising, never negative."""
    level = value_at(F.col("anchor_ts")) + (F.col("amplitude") if upper else F.lit(0.0))
    return F.when(F.col("direction") == "rising", F.greatest(F.lit(0.0), (target - level) / F.col("slope_hour")))


def capacity_forecast(
    df: DataFrame, by: list[str], capacity: float, *, interval_secs: int = 0, max_bit: int = 12, min_samples: int = 8
) -> DataFrame:
    """Grid on [0, capacity], trend and moves of each key: headroom, drift and hours to full.

    Moves are between intervals of ``interval_secs``; 0: a 64th of the key's time span, at least a second.

    hours_to_top_cell <= hours_to_full <= hours_to_trend_full wherever they exist.
    """
    d = df.withColumn("gmin", F.lit(0.0)).withColumn("gmax", F.lit(float(capacity)))
    fitted = G.grid_fit(d, by, max_bit=max(1, min(16, max_bit)))
    trend = trend_fit(df, by, min_samples=min_samples)
    secs = F.greatest(F.lit(1), F.floor((F.max("ts") - F.min("ts")) / 64)) if interval_secs <= 0 else F.lit(interval_secs)
    spaced = df.join(df.groupBy(*by).agg(F.min("ts").alias("__t0"), secs.cast("bigint").alias("__secs")), by)
    spaced = spaced.withColumn("ts", F.floor((F.col("ts") - F.col("__t0")) / F.col("__secs")).cast("bigint"))
    moves = G.move_probabilities(G.transitions(G.dominant_cells(spaced.select(*by, "ts", "seq", "value"), by, fitted, 1), by), by)
    x = trend.join(fitted.drop("offset"), by).withColumn("goffset", F.col("gmin")).join(moves, by, "left")
    top_edge = F.lit(float(capacity)) - F.col("step")
    return x.select(
        *by, "direction", "current", (F.lit(capacity) - F.col("current")).alias("headroom"),
        ((F.lit(capacity) - F.col("current")) / capacity).alias("headroom_rel"),
        (F.col("amplitude") > 0.02 * capacity).alias("oscillating"), (F.col("amplitude") / capacity).alias("amplitude_rel"),
        F.ceil(F.col("amplitude") / F.col("step")).cast("long").alias("envelope_cells"),
        F.greatest(F.lit(0), F.least(F.col("num_cells") - 1, F.floor(F.col("current") / F.col("step")))).cast("long").alias("current_cell"),
        (F.col("num_cells") - 1).cast("long").alias("top_cell"), "step",
        (F.coalesce("up", F.lit(0.0)) - F.coalesce("down", F.lit(0.0))).alias("drift"),
        hours_to(top_edge, upper=True).alias("hours_to_top_cell"), hours_to(F.lit(float(capacity)), upper=True).alias("hours_to_full"),
        hours_to(F.lit(float(capacity))).alias("hours_to_trend_full"),
    )


def capacity_report(forecast: DataFrame, by: list[str]) -> DataFrame:
    """Three observations per key; -1 means no time of arrival."""
    names = ("hours_to_top_cell", "hours_to_full", "hours_to_trend_full")
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.coalesce(n, F.lit(-1.0)).alias("value")) for n in names])
    return forecast.select(*by, F.explode(pairs).alias("x")).select(*by, "x.metric", "x.value")


def grid_band_report(df: DataFrame, by: list[str], label: str, secs: int) -> DataFrame:
    """Latest value per label within the recent window, its cell and the cell's edges."""
    from tidemark.operators.timeseries import latest_per_label, recent_window

    recent = recent_window(df, by, secs)
    fitted = G.fit_values(recent, by)
    d = latest_per_label(recent, by, label).join(fitted, by).withColumn("cell", G.cell_of(F.col("value")))
    low = F.col("offset") + F.col("cell") * F.col("step")
    return d.select(*by, "label", "value", "cell", low.alias("low"), (low + F.col("step")).alias("high"), "num_cells")


def next_step_forecast(df: DataFrame, by: list[str], interval_secs: int, *, max_bit: int = 8, now: int | None = None) -> DataFrame:
    """Last value plus (P(up) - P(down)) cells and how it came about.

    ``steady``: fewer than two points or no span; ``grid-window``: no interval to look at moves (``interval_secs`` is 0);
    else ``grid-transition``.  With ``now``, only points at least a minute old and of metrics that aren't live samples
    (``_live_`` in the id) count.
    """
    if now is not None:
        df = df.where((F.col("ts") <= now - 60) & ~F.col("metric_id").contains("_live_"))
    fitted = G.fit_values(df, by, max_bit=max_bit)
    last = df.where("value IS NOT NULL").groupBy(*by).agg(F.max_by("value", F.struct("ts", "seq")).alias("last"), F.max("ts").alias("ts"), F.count("*").alias("points"))
    d = last.join(fitted.select(*by, "step", (F.col("gmax") > F.col("gmin")).alias("span")), by)
    moving = (F.col("points") >= 2) & F.col("span")
    if interval_secs <= 0:
        return d.select(*by, "ts", F.col("last").alias("forecast"), F.when(moving, "grid-window").otherwise("steady").alias("method"))
    moves = G.move_probabilities(G.transitions(G.dominant_cells(df, by, fitted, interval_secs), by), by)
    drift = F.when(moving, F.coalesce(F.col("up") - F.col("down"), F.lit(0.0))).otherwise(0.0)
    d = d.join(moves, by, "left")
    return d.select(*by, "ts", (F.col("last") + drift * F.col("step")).alias("forecast"), F.when(moving, "grid-transition").otherwise("steady").alias("method"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], *, values: list[str], ts: str = "ts", allow_equal: bool = True) -> DataFrame:
    """Each left row with the right row of the greatest ts at or before its own.

    Both sides are put in one ordered sequence and the last right row is carried forward; where keys have many rows, inside
    slices of bounded size, and what crosses a slice border comes from the slices' last right rows.
    """
    from pyspark.sql import Window

    from tidemark.operators.sliced import fits, with_slices

    own = F.struct(*[F.col(c) for c in left.columns])
    other = F.struct(F.col(ts).alias("right_ts"), *[F.col(v).alias(f"right_{v}") for v in values])
    a = left.select(*by, F.col(ts).alias("__ts"), F.lit(1 if allow_equal else -1).alias("__side"), own.alias("l"), F.lit(None).cast(right.select(other.alias("r")).schema[0].dataType).alias("r"))
    b = right.select(*by, F.col(ts).alias("__ts"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(own.alias("l")).schema[0].dataType).alias("l"), other.alias("r"))
    d = a.unionByName(b)
    if fits(d, by):
        carried = F.last("r", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0))
        return d.withColumn("m", carried).where("l IS NOT NULL").select("l.*", "m.*")
    # Rows of one side and ts may be parted anyhow: left rows only read, and the newest right row of a ts is as good as another.
    place = F.shiftleft(F.col("__side").cast("bigint"), 40) + F.pmod(F.xxhash64("l", "r"), F.lit(1 << 40))
    d = with_slices(d.withColumn("__place", place), by, ts="__ts", seq="__place")
    inside = Window.partitionBy(*by, "__slice").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    edges = d.where("r IS NOT NULL").groupBy(*by, "__slice").agg(F.max_by("r", "__ts").alias("__last"))
    slices = d.select(*by, "__slice").distinct().join(edges, [*by, "__slice"], "left")
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.select(*by, "__slice", F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    d = d.withColumn("__in", F.last("r", ignorenulls=True).over(inside)).join(carry, [*by, "__slice"])
    d = d.where("l IS NOT NULL").withColumn("m", F.coalesce("__in", "__carry"))
    return d.select("l.*", "m.*")


def verify_forecast(actual: DataFrame, predicted: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """1 where the newest prediction at or before a sample is within ``tolerance`` of it, and the difference."""
    d = asof_join(actual, predicted, by, values=["value"]).where("right_ts IS NOT NULL")
    gap = F.col("value") - F.col("right_value")
    return d.withColumn("delta", gap).withColumn("hit", (F.abs(gap) <= tolerance).cast("int"))
