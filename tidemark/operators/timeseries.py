"""Keyed time-series operators over (by..., ts, value, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import floored, linear, order_statistics, upper_median
from tidemark.operators.sliced import frames_fit, joined, with_lag, with_running
from tidemark.operators.spans import by_second

AGGREGATES = {"avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def rate(df: DataFrame, by: list[str]) -> DataFrame:
    """(last - first) / seconds; null with fewer than two points or no time between them."""
    at = F.struct("ts", "seq")
    g = df.where("value IS NOT NULL").groupBy(*by).agg(
        F.count("value").alias("n"),
        F.min("ts").alias("t0"), F.max("ts").alias("t1"),
        F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last"),
    )
    span = F.col("t1") - F.col("t0")
    return g.select(*by, F.when((F.col("n") >= 2) & (span > 0), (F.col("last") - F.col("first")) / span).alias("rate"))


def moving_avg(df: DataFrame, by: list[str], window_secs: int) -> DataFrame:
    """Mean over [ts - w, ts] of rows at or before the row by (ts, seq).

    Where keys have many rows: differences of running sums (`spans`) give the part of earlier seconds, running sums that of the row's own second.
    """
    if frames_fit(df, by):
        part = Window.partitionBy(*by).orderBy("ts")
        ties = Window.partitionBy(*by, "ts").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
        frame = part.rangeBetween(-window_secs, 0)
        total = F.sum("value").over(frame) - F.coalesce(F.sum("value").over(ties), F.lit(0.0))
        n = F.count("value").over(frame) - F.count("value").over(ties)
        return df.withColumn("moving_avg", total / n)
    before = by_second(df, by, window_secs, -1)
    d = df.withColumn("__second", F.col("ts"))
    d = with_running(d, [*by, "__second"], {"__now": F.col("value"), "__here": F.col("value").isNotNull().cast("bigint")})
    d = joined(d, before.select(*by, F.col("ts").alias("__second"), F.col("__s1").alias("__before"), F.col("__w").alias("__earlier")), [*by, "__second"])
    n = F.coalesce("__earlier", F.lit(0)) + F.col("__here")
    return d.withColumn("moving_avg", F.when(n > 0, (F.coalesce("__before", F.lit(0.0)) + F.col("__now")) / n)).select(*df.columns, "moving_avg")


def resample(df: DataFrame, by: list[str], bucket_secs: int, agg: str = "avg", anchor: str = "first") -> DataFrame:
    """Buckets anchored at the key's first ts (or the epoch); empty ones are left out; an unknown aggregate is avg."""
    fn = AGGREGATES.get(agg, F.avg)
    if anchor == "first":
        start = df.groupBy(*by).agg(F.min("ts").alias("t0"))
        df = df.join(start, by)
    else:
        df = df.withColumn("t0", F.lit(0).cast("bigint"))
    bucket = F.col("t0") + F.floor((F.col("ts") - F.col("t0")) / bucket_secs) * bucket_secs
    return df.groupBy(*by, bucket.cast("bigint").alias("bucket")).agg(fn("value").cast("double").alias("value"))


def quantile(df: DataFrame, by: list[str], q: float) -> DataFrame:
    """q = 0.5 interpolates; any other q (clamped to 0..1) is the sorted value at floor(q (n - 1))."""
    q = min(1.0, max(0.0, q))
    return order_statistics(df, by, {"quantile": (q, linear(q) if q == 0.5 else floored(q))})


def p95(df: DataFrame, by: list[str]) -> DataFrame:
    return quantile(df, by, 0.95)


def p99(df: DataFrame, by: list[str]) -> DataFrame:
    return quantile(df, by, 0.99)


def delta(df: DataFrame, by: list[str]) -> DataFrame:
    """Differences of consecutive values; the first row of a key has none and is left out."""
    d = with_lag(df.where("value IS NOT NULL"), by, {"prev": "value"})
    return d.where("prev IS NOT NULL").withColumn("delta", F.col("value") - F.col("prev")).drop("prev")


def pct_change(df: DataFrame, by: list[str], *, flat: bool = True) -> DataFrame:
    """(current - previous) / |previous| as a fraction, 0 where |previous| is below 1e-12.

    ``flat`` False: the plain quotient everywhere, so infinite (0 after 0: NaN) where the previous value is 0.
    """
    d = with_lag(df.where("value IS NOT NULL"), by, {"prev": "value"}).where("prev IS NOT NULL")
    if flat:
        change = F.when(F.abs("prev") < 1e-12, 0.0).otherwise((F.col("value") - F.col("prev")) / F.abs("prev"))
    else:
        step = F.col("value") - F.col("prev")
        at_zero = F.when(step > 0, float("inf")).when(step < 0, float("-inf")).otherwise(float("nan"))
        change = F.when(F.col("prev") == 0, at_zero).otherwise(step / F.abs("prev"))
    return d.withColumn("pct_change", change).drop("prev")


def summary_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Count, min, max, mean and sample variance (0 below two rows), stamped with the batch's last ts."""
    return df.groupBy(*by).agg(
        F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"), F.max("ts").alias("ts"),
    )


def batch_mean(df: DataFrame, by: list[str]) -> DataFrame:
    """Each row with its group's mean, as metric ``<m>_mean``."""
    means = df.groupBy(*by).agg(F.avg("value").alias("batch_mean"))
    return df.join(means, by).withColumn("mean_metric", F.concat(F.col("metric_id"), F.lit("_mean")))


def spike_check(
    df: DataFrame, by: list[str], *, baseline: float | None = None, saturated: float = 0.9, spike_delta: float = 0.05
) -> DataFrame:
    """Label rows ok, spike, saturated or no-baseline against a baseline (default: the group's mean)."""
    if baseline is None:
        df = df.join(df.groupBy(*by).agg(F.avg("value").alias("baseline")), by)
    else:
        df = df.withColumn("baseline", F.lit(baseline))
    d = df.withColumn("delta", F.col("value") - F.col("baseline"))
    label = (
        F.when(F.col("value") >= saturated, "saturated")
        .when(F.col("baseline").isNull(), "no-baseline")
        .when(F.col("delta") > spike_delta, "spike")
        .otherwise("ok")
    )
    return d.withColumn("label", label)


def recent_window(df: DataFrame, by: list[str], secs: int) -> DataFrame:
    """Rows with ts > last ts - secs."""
    last = df.groupBy(*by).agg(F.max("ts").alias("last_ts"))
    return df.join(last, by).where(F.col("ts") > F.col("last_ts") - secs).drop("last_ts")


def before_window(df: DataFrame, by: list[str], secs: int) -> DataFrame:
    """Rows with ts <= last ts - secs: what `recent_window` leaves out."""
    last = df.groupBy(*by).agg(F.max("ts").alias("last_ts"))
    return df.join(last, by).where(F.col("ts") <= F.col("last_ts") - secs).drop("last_ts")


def latest_per_label(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Latest value of each label value (``?`` if missing); equal ts: the first row."""
    key = F.coalesce(F.col("labels")[label], F.lit("?"))
    return df.groupBy(*by, key.alias("label")).agg(
        F.max_by("value", F.struct(F.col("ts"), -F.col("seq"))).alias("value"), F.max("ts").alias("ts")
    )


def sampling_interval(df: DataFrame, by: list[str]) -> DataFrame:
    """Whole seconds between points on average; 0 below two points."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    mean = F.floor((F.col("t1") - F.col("t0")) / F.greatest(F.col("n") - 1, F.lit(1)))
    return g.select(*by, F.when(F.col("n") < 2, 0).otherwise(mean).cast("bigint").alias("interval"))


def median_gap(df: DataFrame, by: list[str], default: int = 60) -> DataFrame:
    """Upper median of the gaps between points (sorted gaps at n div 2); ``default`` without a gap."""
    gaps = with_lag(df, by, {"before": "ts"}).where("before IS NOT NULL").select(*by, (F.col("ts") - F.col("before")).alias("gap"))
    found = order_statistics(gaps, by, {"gap": (0.5, upper_median)}, "gap")
    return df.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce("gap", F.lit(default)).cast("bigint").alias("median_gap"))


def bucket_align(ts: Column, secs: int) -> Column:
    """Start of the bucket that holds ``ts``, also before the epoch; 0 seconds: one bucket."""
    return F.lit(0).cast("bigint") if secs == 0 else (F.floor(ts / secs) * secs).cast("bigint")


def gap_fill(df: DataFrame, by: list[str], bucket: str, secs: int, zeros: list[str]) -> DataFrame:
    """Rows of zeros for the buckets that are missing between a key's first and last."""
    ends = df.groupBy(*by).agg(F.min(bucket).alias("lo"), F.max(bucket).alias("hi")) if by else df.agg(F.min(bucket).alias("lo"), F.max(bucket).alias("hi"))
    spine = ends.where("lo IS NOT NULL").select(*by, F.explode(F.sequence("lo", "hi", F.lit(secs).cast("bigint"))).alias(bucket))
    return spine.join(df, [*by, bucket], "left").fillna(0, zeros)


RESOLUTIONS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14_400, "1d": 86_400, "1w": 604_800, "1M": 2_592_000, "0": 0}


def parse_resolution(text: str) -> int:
    """Seconds of a strict resolution name."""
    if text not in RESOLUTIONS:
        raise ValueError(f"unknown resolution {text!r}")
    return RESOLUTIONS[text]


def resolution_secs(text: str) -> int:
    """Digits and a unit s, m, h, d or w; anything else is a minute."""
    units = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}
    digits, unit = text[:-1], text[-1:]
    return int(digits) * units[unit] if digits.isdigit() and unit in units and int(digits) > 0 else 60


def dedup_exact(df: DataFrame) -> DataFrame:
    """One copy of observations that agree in all fields, labels in any order."""
    key = F.array_sort(F.map_entries("labels"))
    return df.withColumn("__labels", key).dropDuplicates([*[c for c in df.columns if c not in ("labels", "seq")], "__labels"]).drop("__labels")
