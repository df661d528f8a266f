"""Rows of large keys stay where they are when they meet one row for each key; runs of losses are told by one order."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger, trend


@pytest.fixture
def close_to_limit(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows(spark):
    return spark.range(20_000).select(F.col("id").alias("ts"), F.col("id").alias("seq"), (F.col("id") % 2).alias("k"), (F.col("id") * 0.5 + F.col("id") % 7).alias("value"))


def sorts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")


def test_time_split_moves_no_rows(close_to_limit):
    got = ledger.time_split(rows(close_to_limit), ["k"])
    assert sorts(got) == 0 and {(r.k, r.part): r["count"] for r in got.groupBy("k", "part").count().collect()} == {(k, p): n for k in (0, 1) for p, n in (("train", 8000), ("test", 2000))}


def test_trend_moves_no_rows(close_to_limit, monkeypatch):
    met = []
    monkeypatch.setattr(trend, "quantiles", lambda df, *a, f=trend.quantiles, **k: met.append(df) or f(df, *a, **k))
    got = {r.k: (r.samples, round(r.slope, 3)) for r in trend.trend_fit(rows(close_to_limit), ["k"]).collect()}
    assert sorts(met[0]) == 0 and got == {0: (10_000, 0.5), 1: (10_000, 0.5)}


def test_loss_runs_order_ties_by_order_id(spark):
    shape = "k string, ts long, seq long, order_id string, status string, pnl_pct double"
    d = spark.createDataFrame([("a", 1, 1, i, "closed", p) for i, p in (("c", -1.0), ("a", -2.0), ("b", 1.0))] + [("a", 2, 1, "d", "closed", -1.0), ("a", 3, 1, "e", "closed", 1.0)], shape).coalesce(1)
    assert sorted((r.start, r.length) for r in ledger.loss_runs(d, ["k"]).collect()) == [(1, 1), (1, 2)]
