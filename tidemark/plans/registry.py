"""User-defined transforms: named functions from observations to observations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import valid_observation

_transforms: dict[str, Callable[..., DataFrame]] = {}


def transform(name: str) -> Callable:
    """Registers a function (observations, params) -> observations."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _transforms[name] = fn
        return fn

    return add


def apply(name: str, df: DataFrame, params: dict | None = None) -> DataFrame:
    """The function's valid rows; output rows that break the record's rules are dropped."""
    if name not in _transforms:
        raise KeyError(f"no transform {name!r}")
    out = _transforms[name](df, params or {})
    missing = {"ts", "metric_id", "kind", "signal", "value", "labels", "severity"} - set(out.columns)
    if missing:
        raise ValueError(f"the transform's result lacks {sorted(missing)}")
    return out.where(valid_observation())


def keyed(df: DataFrame, by: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A pandas function of each key's rows."""
    return df.groupBy(*by).applyInPandas(fn, schema)


def plan_function(candles: DataFrame, previous: DataFrame, by: list[str], fn: Callable, schema: str, *, min_candles: int) -> DataFrame:
    """A pandas function (candles, previous plans) -> plans of each key; too few candles are an error."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) < min_candles:
            raise ValueError(f"{len(a)} candles, {min_candles} are needed")
        return fn(a.sort_values("t"), b)

    return candles.groupBy(*by).cogroup(previous.groupBy(*by)).applyInPandas(run, schema)


def register_function(spark: SparkSession, name: str, args: str, returns: str, body: str | Callable) -> None:
    """A free function under a name of its own: SQL over its arguments (``"x DOUBLE, y INT"``), or a function of pandas series."""
    if isinstance(body, str):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    else:
        spark.udf.register(name, F.pandas_udf(body, returns))


def register_functions(spark: SparkSession) -> None:
    """SQL functions: bucket_align(ts, secs) and kelly(p, sl)."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bucket_align(ts BIGINT, secs BIGINT) RETURNS BIGINT RETURN floor(ts / secs) * secs")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kelly(p DOUBLE, sl DOUBLE) RETURNS DOUBLE RETURN greatest(0D, (p / sl - (1 - p)) * sl)")


@transform("batch_mean")
def _batch_mean(df: DataFrame, params: dict) -> DataFrame:
    means = df.groupBy("metric_id").agg(F.avg("value").alias("value"), F.max("ts").alias("ts"))
    return means.select(
        "ts", F.concat("metric_id", F.lit(params.get("suffix", "_mean"))).alias("metric_id"), F.lit("metric").alias("kind"), F.lit("summary").alias("signal"),
        "value", F.create_map().cast("map<string,string>").alias("labels"), F.lit(None).cast("string").alias("severity"),
    )
