"""Range queries over stations: tables of observations partitioned by station and time block."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_CAP = 20_000
MAX_LIMIT = 10_000
MAX_WINDOW = 30 * 86_400


def _blocks(df: DataFrame, lo: int, hi: int, block_secs: int | None) -> DataFrame:
    """Prunes partitions by block where the table has them; Catalyst can't derive ``blk`` from ``ts``."""
    if block_secs and "blk" in df.columns:
        first = lo // block_secs
        if not window_fits_cap(lo, hi, block_secs):
            first = hi // block_secs - BLOCK_CAP + 1
            warnings.warn(f"the window has more than {BLOCK_CAP} blocks: only the newest are read", stacklevel=3)
        return df.where(F.col("blk").between(first, hi // block_secs))
    return df


def matches(signal: str | None = None, label_kind: str | None = None, status: str | None = None) -> Column:
    cond = F.lit(True)
    if signal is not None:
        cond = cond & (F.col("signal") == signal)
    if label_kind is not None:
        cond = cond & (F.col("labels")["kind"] == label_kind)
    if status is not None:
        cond = cond & (F.col("labels")["status"] == status)
    return cond


def query_recent(df: DataFrame, lo: int, hi: int, *, block_secs: int | None = None) -> DataFrame:
    """Rows with lo <= ts <= hi; holes don't matter; of a partitioned table only the newest blocks up to the cap, with a warning (see ``window_fits_cap``)."""
    return _blocks(df, lo, hi, block_secs).where(F.col("ts").between(lo, hi))


def window_fits_cap(lo: int, hi: int, block_secs: int) -> bool:
    return hi // block_secs - lo // block_secs < BLOCK_CAP


def block_coverage(df: DataFrame, by: list[str], block_secs: int) -> DataFrame:
    """First and last ts, and rows, of each block."""
    return df.groupBy(*by, F.floor(F.col("ts") / block_secs).cast("bigint").alias("blk")).agg(
        F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count("*").alias("rows")
    )


def query_range(df: DataFrame, coverage: DataFrame, lo: int, hi: int, block_secs: int) -> DataFrame:
    """All or nothing: no row unless ``coverage(blk)`` has every block of the window."""
    wanted = hi // block_secs - lo // block_secs + 1
    whole = coverage.where(F.col("blk").between(lo // block_secs, hi // block_secs)).agg((F.countDistinct("blk") == wanted).alias("whole"))
    return query_recent(df, lo, hi, block_secs=block_secs).crossJoin(F.broadcast(whole)).where("whole").drop("whole")


def check_query_bounds(lo: int, hi: int, limit: int) -> None:
    """Rejects rather than clamps."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
    if hi < lo:
        raise ValueError("the window ends before it begins")
    if hi - lo > MAX_WINDOW:
        raise ValueError("the window is longer than 30 days")


def order_and_limit(df: DataFrame, limit: int, order: str = "desc") -> DataFrame:
    """desc: the newest rows first; asc: the oldest first."""
    keys = [F.desc("ts"), F.desc("seq")] if order == "desc" else [F.asc("ts"), F.asc("seq")]
    return df.orderBy(*keys).limit(limit)


def query_timeseries(
    df: DataFrame, *, now: int, lo: int | None = None, hi: int | None = None, limit: int = 1000, order: str = "desc",
    signal: str | None = None, label_kind: str | None = None, status: str | None = None, block_secs: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The rows, and one row (scanned, truncated, order, complete) about them; complete is false where blocks beyond the cap were left out."""
    hi = now if hi is None else hi
    lo = hi - MAX_WINDOW if lo is None else lo
    check_query_bounds(lo, hi, limit)
    kept = query_recent(df, lo, hi, block_secs=block_secs).where(matches(signal, label_kind, status))
    fits = F.lit(block_secs is None or window_fits_cap(lo, hi, block_secs))
    meta = kept.agg(F.count("*").alias("scanned")).select("scanned", (F.col("scanned") > limit).alias("truncated"), F.lit(order).alias("order"), fits.alias("complete"))
    return order_and_limit(kept, limit, order), meta


def query_lake(df: DataFrame, lo: int, hi: int, metric: str | None = None) -> DataFrame:
    """The analyst's edge rule: lo < ts <= hi, in order."""
    d = df.where((F.col("ts") > lo) & (F.col("ts") <= hi))
    return (d if metric is None else d.where(F.col("metric_id") == metric)).orderBy("ts", "seq")


def latest(df: DataFrame, by: list[str]) -> DataFrame:
    at = F.struct("ts", "seq")
    return df.groupBy(*by).agg(F.max_by("value", at).alias("value"), F.max("ts").alias("ts"))


def first_last(df: DataFrame, by: list[str]) -> DataFrame:
    at = F.struct("ts", "seq")
    return df.groupBy(*by).agg(F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last"))


def latest_n(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows of each key."""
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("seq"))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def list_metrics(df: DataFrame) -> DataFrame:
    return df.select("metric_id").distinct().orderBy("metric_id")


def describe_station(df: DataFrame, by: list[str], block_secs: int) -> DataFrame:
    """Records, blocks, first and last ts, kinds and number of metrics."""
    return df.groupBy(*by).agg(
        F.count("*").alias("records"), F.countDistinct(F.floor(F.col("ts") / block_secs)).alias("blocks"), F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.countDistinct("metric_id").alias("metrics"),
    )


def invalidate_from(df: DataFrame, ts: int) -> DataFrame:
    return df.where(F.col("ts") < ts)


def station_query(stations: DataFrame, name: str, lo: int, hi: int, *, signal: str | None = None, label_kind: str | None = None, block_secs: int | None = None) -> DataFrame | None:
    """Rows of one station of a table partitioned by ``station`` in [lo, hi]; None for a station that isn't there."""
    own = stations.where(F.col("station") == name)
    if own.limit(1).isEmpty():
        return None
    return query_recent(own, lo, hi, block_secs=block_secs).where(matches(signal, label_kind))


def list_stations(stations: DataFrame) -> DataFrame:
    """Station names and the kinds of their rows."""
    return stations.groupBy("station").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def station_status(stations: DataFrame) -> DataFrame:
    """Rows, blocks and newest ts of each station."""
    return stations.groupBy("station").agg(F.count("*").alias("rows"), F.countDistinct("blk").alias("blocks"), F.max("ts").alias("last_ts"))
