"""Metric exposition in the Prometheus text format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import escape_label_value, sanitize_metric_name, series_key


def latest_series(df: DataFrame, now: int, window_secs: int = 120, signals: tuple[str, ...] = ("raw", "summary"), exclude_kinds: tuple[str, ...] = ()) -> DataFrame:
    """Newest row of each (name, labels) with ts >= now - window; orders and step cursors never show; ties: the first."""
    kind = F.coalesce(F.col("labels")["kind"], F.lit(""))
    hidden = ("trading_step", *exclude_kinds)
    d = df.where((F.col("ts") >= now - window_secs) & F.col("signal").isin(*signals) & (F.col("signal") != "order") & ~kind.isin(*hidden))
    row = F.struct("metric_id", "labels", "value", "ts")
    return d.groupBy(series_key(F.col("metric_id"), F.col("labels")).alias("series")).agg(F.max_by(row, F.struct(F.col("ts"), -F.col("seq"))).alias("x")).select("series", "x.*")


def cap_series(series: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` series by key (0: all)."""
    return series.orderBy("series").limit(limit) if limit else series


def dropped_series(series: DataFrame, limit: int) -> DataFrame:
    return series.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("dropped") if limit else F.lit(0).cast("long").alias("dropped"))


def render(series: DataFrame, prefix: str = "app_") -> DataFrame:
    """Lines (name, part, text) of each metric name: HELP (part 0), TYPE (1) and values (2); ordered by name, part and text they are the exposition."""
    name = sanitize_metric_name(F.col("metric_id"), prefix)
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escape_label_value(F.coalesce(e["value"], F.lit(""))), F.lit('"')))
    labels = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    d = series.select(name.alias("name"), F.lit(2).alias("part"), F.concat(name, labels, F.lit(" "), F.col("value").cast("string")).alias("text"))
    heads = d.select("name").distinct().select("name", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("# HELP "), F.col("name"), F.lit(" latest value")).alias("text")),
        F.struct(F.lit(1).alias("part"), F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" gauge")).alias("text")),
    )).alias("x")).select("name", "x.*")
    return d.unionByName(heads)


def node_metrics(status: DataFrame) -> DataFrame:
    """running, faults and info rows of a component table (node, running, faults, kind)."""
    return status.selectExpr("node", "stack(3, 'running', cast(running AS double), 'faults', cast(faults AS double), 'info', 1D) AS (metric, value)")
