"""The record schemas, and adapters that read the driver's tables as them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBS_SCHEMA = (
    "ts bigint, metric_id string, kind string, signal string, value double, "
    "labels map<string,string>, severity string, seq bigint"
)
CANDLE_SCHEMA = "symbol string, resolution string, t bigint, o double, h double, l double, c double, v double"
ORDER_SCHEMA = (
    "ts bigint, order_id string, status string, dtype string, grid int, level int, size double, entry double, "
    "sl double, tp double, unlock_seq bigint, pnl_pct double, exit_price double, seq bigint"
)
KINDS = ("metric", "log", "trace")
SIGNALS = ("utilization", "saturation", "rate", "errors", "duration", "raw", "summary", "order")
SEVERITIES = ("debug", "info", "warn", "error")


def identity(labels: str | Column = "labels") -> Column:
    """A comparable form of a label map: sorted entries."""
    return F.array_sort(F.map_entries(labels))


def valid_observation() -> Column:
    """Rows that satisfy the record's enumerations."""
    return (
        F.col("ts").isNotNull()
        & F.col("metric_id").isNotNull()
        & F.col("kind").isin(*KINDS)
        & F.col("signal").isin(*SIGNALS)
        & (F.col("severity").isNull() | F.col("severity").isin(*SEVERITIES))
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as observations: one metric for each event type, seconds, event id as sequence."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.floor(micros / 1_000_000).cast("bigint").alias("ts"),
        F.col("event_type").alias("metric_id"),
        F.lit("metric").alias("kind"),
        F.lit("raw").alias("signal"),
        F.col("value").cast("double").alias("value"),
        F.create_map(
            F.lit("user_id"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k")
        ).alias("labels"),
        F.lit(None).cast("string").alias("severity"),
        F.col("event_id").cast("bigint").alias("seq"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as an order ledger; ``seq`` makes the order of equal timestamps total."""
    li = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_linestatus") == "F", "closed").otherwise("open")
    return li.select(
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("order_id"),
        status.alias("status"),
        F.when(F.col("l_returnflag") == "A", "long").when(F.col("l_returnflag") == "R", "short").otherwise("unknown").alias("dtype"),
        (F.col("l_suppkey") % 4).cast("int").alias("grid"),
        F.col("l_linenumber").cast("int").alias("level"),
        F.col("l_quantity").cast("double").alias("size"),
        (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("entry"),
        F.lit(None).cast("double").alias("sl"),
        F.lit(None).cast("double").alias("tp"),
        F.lit(None).cast("bigint").alias("unlock_seq"),
        F.when(status == "closed", (F.col("l_discount") - F.col("l_tax")).cast("double")).alias("pnl_pct"),
        F.lit(None).cast("double").alias("exit_price"),
        (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")).cast("bigint").alias("seq"),
    )
