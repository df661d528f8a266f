"""Capacity planning: exceedance, peaks, growth, exhaustion, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import quantiles
from tidemark.operators.sliced import fits, joined, with_lag, with_running

LATENCY = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 0.9999)


def prob_exceed(df: DataFrame, by: list[str], threshold: float = 80.0, window_secs: int = 3600) -> DataFrame:
    """Overall and latest trailing-window share above the threshold, the current value and whether it exceeds."""
    at = F.struct("ts", "seq")
    last = df.groupBy(*by).agg(F.max("ts").alias("__last"))
    d = joined(df, last, by).withColumn("__up", (F.col("value") > threshold).cast("double"))
    return d.groupBy(*by).agg(  # the latest window is all that is asked for: no need of every row's own
        F.avg("__up").alias("probability"), F.avg(F.when(F.col("ts") > F.col("__last") - window_secs, F.col("__up"))).alias("recent"), F.max_by("value", at).alias("current"),
        F.max_by(F.col("value") > threshold, at).alias("exceeds_now"),
    )


def peaks(df: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Runs above the threshold: start, end (the first ts not above, or the last ts), duration, max, mean."""
    d = df.where("value IS NOT NULL").withColumn("up", (F.col("value") > threshold).cast("int"))
    whole = fits(d, by)
    d = with_lag(d, by, {"before": "up"}, whole=whole)
    d = with_running(d, by, {"run": (F.coalesce("before", F.lit(-1)) != F.col("up")).cast("long")}, whole=whole)
    runs = d.groupBy(*by, "run", "up").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.max("value").alias("peak"), F.avg("value").alias("mean"), F.count("*").alias("points"))
    end = F.coalesce(F.lead("start").over(Window.partitionBy(*by).orderBy("run")), F.col("last"))
    return runs.withColumn("end", end).where("up = 1").select(*by, "start", "end", (F.col("end") - F.col("start")).alias("duration"), "peak", "mean", "points")


def peak_summary(df: DataFrame, by: list[str], threshold: float) -> DataFrame:
    return peaks(df, by, threshold).groupBy(*by).agg(
        F.count("*").alias("peaks"), F.sum("duration").alias("total_secs"), F.max("duration").alias("longest"), F.max("peak").alias("highest")
    )


def growth_rate(df: DataFrame, by: list[str], model: str = "linear", *, x: str = "index") -> DataFrame:
    """Regression on the row index (or seconds with ``x='ts'``): linear, exponential (log of y + 1e-10) or polynomial."""
    d = df.where("value IS NOT NULL")
    if x == "ts":
        d = d.join(d.groupBy(*by).agg(F.min("ts").alias("t0")), by).withColumn("x", (F.col("ts") - F.col("t0")).cast("double"))
    else:
        d = with_running(d.withColumn("one", F.lit(1).cast("long")), by, {"i": F.col("one")}).withColumn("x", (F.col("i") - 1).cast("double"))
    y = F.log(F.col("value") + 1e-10) if model == "exponential" else F.col("value")
    d = d.withColumn("y", y)
    if model in ("linear", "exponential"):
        g = d.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.max("x").alias("last_x"))
        return g.where("n >= 3").withColumn("quadratic", F.lit(0.0)).withColumn("per_day", F.col("slope") * 86_400)
    if model not in ("polynomial", "quadratic"):
        raise ValueError(f"unknown model {model!r}")
    m = d.groupBy(*by).agg(F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"))
    d = d.join(m, by).withColumn("u", (F.col("x") - F.col("mx")) / F.when(F.col("sx") > 0, F.col("sx")).otherwise(1.0))
    s = d.groupBy(*by, "mx", "sx").agg(F.count("*").alias("n"), F.max("x").alias("last_x"), *[F.sum(F.col("u") ** k).alias(f"u{k}") for k in range(1, 5)], *[F.sum(F.col("y") * F.col("u") ** k).alias(f"y{k}") for k in range(3)])
    s = s.where("n >= 3")
    # normalised u: sum u = 0, sum u^2 = n, so the 3 x 3 system has a closed form
    n, u3, u4 = F.col("n"), F.col("u3"), F.col("u4")
    det = n * u4 - n * n - u3 * u3
    c2 = (n * F.col("y2") - n * F.col("y0") - u3 * F.col("y1")) / det
    c1 = (F.col("y1") - u3 * c2) / n
    c0 = F.col("y0") / n - c2
    sx, mx = F.col("sx"), F.col("mx")
    q = c2 / (sx * sx)
    slope = c1 / sx - 2 * c2 * mx / (sx * sx)
    return s.select(*by, "n", slope.alias("slope"), (c0 - c1 * mx / sx + c2 * mx * mx / (sx * sx)).alias("intercept"), q.alias("quadratic"), "last_x", (slope * 86_400).alias("per_day"))


def _current(df: DataFrame, by: list[str]) -> DataFrame:
    return df.where("value IS NOT NULL").groupBy(*by).agg(F.max_by("value", F.struct("ts", "seq")).alias("current"))


def time_to_exhaustion(df: DataFrame, by: list[str], capacity: float, model: str = "linear") -> DataFrame:
    """ALREADY_EXCEEDED, NOT_GROWING or PROJECTED with the steps that are left, from the current value at the fitted rate.

    Linear: what remains by the slope; exponential: log(capacity / current) by log(1 + rate), rate = exp(slope) - 1.
    """
    if model not in ("linear", "exponential"):
        raise ValueError(f"unknown model {model!r}")
    d = growth_rate(df, by, model).join(_current(df, by), by)
    goal = F.lit(float(capacity))
    left = (goal - F.col("current")) / F.col("slope") if model == "linear" else F.log(goal / F.col("current")) / F.col("slope")
    status = F.when(F.col("current") >= goal, "ALREADY_EXCEEDED").when(F.col("slope") <= 0, "NOT_GROWING").otherwise("PROJECTED")
    steps = F.when(F.col("status") == "PROJECTED", left).when(F.col("status") == "ALREADY_EXCEEDED", 0.0)
    return d.withColumn("status", status).select(*by, "status", "current", steps.alias("steps_left"))


def projection(df: DataFrame, by: list[str], days: list[float], model: str = "linear") -> DataFrame:
    """Value after ``days`` of 86 400 steps (rows): linear and exponential from the current value, quadratic (or polynomial) on the fitted curve.

    The exponential rate a day is 86 400 times the rate a step, compounded by day.
    """
    d = growth_rate(df, by, model).join(_current(df, by), by).withColumn("days", F.explode(F.array(*[F.lit(float(x)) for x in days])))
    x = F.col("last_x") + F.col("days") * 86_400
    value = {
        "linear": F.col("current") + F.col("slope") * 86_400 * F.col("days"),
        "exponential": F.col("current") * F.pow(1 + F.expm1("slope") * 86_400, F.col("days")),
    }.get(model, F.col("intercept") + F.col("slope") * x + F.col("quadratic") * x * x)
    return d.select(*by, "days", value.alias("value"))


def latency_percentiles(df: DataFrame, by: list[str], *, approx: bool = False) -> DataFrame:
    names = {"p" + f"{p * 100:g}".replace(".", "_"): p for p in LATENCY}
    moments = [F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("count")]
    if approx:
        g = df.groupBy(*by).agg(F.approx_percentile("value", F.array(*[F.lit(p) for p in LATENCY]), 10_000).alias("q"), *moments)
        return g.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(names)], "mean", "std", "min", "max", "count")
    of = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}
    return quantiles(df, by, names, also={n: f("__x") for n, f in of.items()})


def latency_tail(df: DataFrame, by: list[str], q: float = 0.99) -> DataFrame:
    """Threshold, count, share, mean and max of the tail; a Pareto exponent if it has more than 10 rows."""
    at = quantiles(df, by, {"threshold": q}).join(df.groupBy(*by).agg(F.count("value").alias("n")), by)
    t = df.join(at, by).where("value > threshold")
    g = t.groupBy(*by, "threshold", "n").agg(F.count("*").alias("tail"), F.avg("value").alias("tail_mean"), F.max("value").alias("tail_max"), F.min("value").alias("low"), F.sum(F.log("value")).alias("logs"))
    alpha = F.col("tail") / (F.col("logs") - F.col("tail") * F.log("low"))
    return g.select(*by, "threshold", "tail", (F.col("tail") / F.col("n")).alias("share"), "tail_mean", "tail_max", F.when(F.col("tail") > 10, alpha).alias("pareto_alpha"))


def deployment_comparison(df: DataFrame, group: str) -> DataFrame:
    return latency_percentiles(df, [group])
