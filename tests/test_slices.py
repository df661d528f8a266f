"""Slices bounded by rows: same answers as one window, and no window above the bound, however dense a key is."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import candles, capacity, grid, ledger, probability, sliced, stats, timeseries, trend
from tidemark.streaming import jobs


@pytest.fixture(scope="module")
def bursts(spark, tmp_path_factory):
    """Two keys: one sparse over years, one of 6 000 rows that mostly lie in one second."""
    rows = [("sparse", i * 40_000, 7 * i, float(i * 37 % 101)) for i in range(120)]
    rows += [("dense", 86_400 * 20_000 + (i // 10 if i < 900 else 500), (i * 7919) % 6011 * 10**9, float(i * 31 % 97)) for i in range(6000)]
    path = str(tmp_path_factory.mktemp("bursts"))
    spark.createDataFrame(rows, "k string, ts bigint, seq bigint, value double").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


BY = ["k"]


def both(monkeypatch, make, rows=50):
    """What ``make`` gives with one window a key and with slices of ``rows`` rows."""
    want = rounded(make())
    monkeypatch.setattr(sliced, "ROWS", rows)
    return want, rounded(make())


def rounded(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_slices_are_bounded_and_ordered(bursts):
    d = sliced.with_slices(bursts, BY, rows=50)
    assert d.groupBy("k", "__slice").count().agg(F.max("count")).first()[0] <= 150
    spans = d.groupBy("k", "__slice").agg(F.min(F.struct("ts", "seq")).alias("a"), F.max(F.struct("ts", "seq")).alias("b")).orderBy("k", "__slice").collect()
    assert len(spans) > 100
    for x, y in zip(spans, spans[1:], strict=False):
        assert x.k != y.k or tuple(x.b) < tuple(y.a)
    assert sliced.with_slices(bursts.limit(0), BY, rows=50).count() == 0


def test_a_million_rows_of_one_key_in_one_day(spark):
    """Half of them lie in one second."""
    d = spark.range(2_000_000).select(F.lit("a").alias("k"), F.when(F.col("id") < 1_000_000, F.floor(F.col("id") / 12)).otherwise(86_000).cast("bigint").alias("ts"), F.col("id").alias("seq"))
    sizes = sliced.with_slices(d, BY, rows=20_000).groupBy("k", "__slice").count()
    assert sizes.agg(F.max("count"), F.sum("count")).first()[:] == (sizes.agg(F.max("count")).first()[0], 2_000_000)
    assert sizes.agg(F.max("count")).first()[0] <= 60_000


@pytest.mark.parametrize(
    "make",
    [
        lambda d: timeseries.moving_avg(d, BY, 3), lambda d: timeseries.delta(d, BY), lambda d: timeseries.median_gap(d, BY), lambda d: timeseries.pct_change(d, BY),
        lambda d: stats.rolling(d, BY, 30, ["mean", "std", "min", "max", "count", "skew", "kurt"]), lambda d: stats.rolling(d, BY, 30, ["mean"], center=True),
        lambda d: stats.acf(d, BY, 3), lambda d: stats.seasonal_decompose(d, BY, 4), lambda d: stats._newest(d, BY, 5),
        lambda d: capacity.peaks(d, BY, 50.0), lambda d: capacity.growth_rate(d, BY), lambda d: grid.efficiency_ratio(d, BY),
        lambda d: grid.grid_fit(d.withColumn("gmin", F.lit(0.0)).withColumn("gmax", F.lit(101.0)), BY), lambda d: probability.ecdf(d, BY),
        lambda d: jobs.late_rows(d, BY, 5), lambda d: candles.ohlcv_window(d.select("k", F.col("seq").alias("t"), *[F.col("value").alias(c) for c in "ohlc"]), BY, 3),
        lambda d: ledger.trade_report(d.select("k", "ts", "seq", (F.col("value") / 1000 - 0.04).alias("pnl_pct"), F.lit(2.0).alias("size"), F.lit("closed").alias("status"), F.lit("long").alias("dtype")), BY),
        lambda d: trend.asof_join(d, d.where("seq % 3 = 0").groupBy("k", "ts").agg(F.max("value").alias("value")), BY, values=["value"]),
    ],
)
def test_operators_give_the_same_in_slices(bursts, monkeypatch, make):
    want, got = both(monkeypatch, lambda: make(bursts))
    assert want and got == want
