"""Windows of time whose cost doesn't follow the rows in them."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import capacity, sliced, spans, stats, timeseries

BY = ["k"]
FNS = ["mean", "std", "min", "max", "count", "skew", "kurt", "median", "quantile"]


def test_windows_by_running_sums_equal_frames(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(["a", "b", None][i % 3], int(t), i, None if i % 11 == 0 else float(v)) for i, (t, v) in enumerate(zip(rng.integers(0, 400_000, 600) // 50 * 50, rng.integers(0, 9, 600), strict=True))]
    d = spark.createDataFrame(rows, "k string, ts long, seq long, value double")
    for center in (False, True):
        want = {r.seq: r for r in stats.rolling(d, BY, 7200, FNS, center=center, q=0.3).collect()}
        with monkeypatch.context() as m:
            m.setattr(sliced, "ROWS", 50)
            got = {r.seq: r for r in stats.rolling(d, BY, 7200, FNS, center=center, q=0.3).collect()}
        assert got.keys() == want.keys()
        for s, w in want.items():
            for f in FNS:
                a, b = got[s][f"rolling_{f}"], w[f"rolling_{f}"]
                if f in ("skew", "kurt") and (b is None or b != b):  # no spread
                    assert a is None or a != a
                else:
                    assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9)), (s, f, a, b)
    want = {r.seq: r.moving_avg for r in timeseries.moving_avg(d, BY, 7200).collect()}
    monkeypatch.setattr(sliced, "ROWS", 50)
    got = {r.seq: r.moving_avg for r in timeseries.moving_avg(d, BY, 7200).collect()}
    assert got.keys() == want.keys() and all((got[s] is None) == (w is None) and (w is None or got[s] == pytest.approx(w)) for s, w in want.items())


def test_nan_and_infinite_values_stay_in_their_windows(spark, monkeypatch):
    monkeypatch.setattr(sliced, "ROWS", 1)
    d = spark.createDataFrame([("a", t, t, v) for t, v in enumerate([1.0, float("nan"), 3.0, 4.0, float("inf"), 6.0, 7.0, 8.0])], "k string, ts long, seq long, value double")
    w = spans.by_second(d, BY, 1, extremes=True, quantiles=[0.5]).orderBy("ts").collect()
    assert [r.__getitem__("__s1") for r in w][3] == 7.0 and w[7]["__s1"] == 15.0 and w[1]["__s1"] != w[1]["__s1"] and w[5]["__s1"] == float("inf")
    assert w[2]["__hi"] != w[2]["__hi"] and w[2]["__lo"] == 3.0 and w[3]["__q0"] == 3.5 and w[7]["__q0"] == 7.5


def test_wide_windows_of_many_rows_are_not_added_up_anew(spark):
    """160 000 rows whose windows hold 40 000 each: some ten billion steps, if frames were walked for each row."""
    n = 160_000
    d = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("ts"), F.col("id").alias("seq"), (F.col("id") % 7).cast("double").alias("value"))
    start = time.time()
    r = stats.rolling(d, BY, 40_000, ["mean", "max", "median"]).where("ts = 159999").first()
    m = timeseries.moving_avg(d, BY, 40_000).where("ts = 159999").first()
    p = capacity.prob_exceed(d, BY, 3.5, 40_000).first()
    last = np.arange(n)[-40_000:] % 7
    assert (r.rolling_max, r.rolling_median) == (6.0, np.median(last)) and r.rolling_mean == pytest.approx(last.mean())
    assert m.moving_avg == pytest.approx((np.arange(n)[-40_001:] % 7).mean()) and p.recent == pytest.approx((last > 3.5).mean())
    assert time.time() - start < 60


def test_unit_root_sums_of_slices_equal_those_of_one(spark, monkeypatch):
    y = np.cumsum(np.random.default_rng(8).normal(size=3000)) * 0.2 + np.random.default_rng(9).normal(size=3000)
    d = spark.createDataFrame([("a" if i % 3 else "b", i, i, float(v)) for i, v in enumerate(y)], "k string, ts long, seq long, value double")
    want = {r.k: r for r in stats.adf_test(d, BY, 20).collect()}
    monkeypatch.setattr(stats, "ADF_SLICE_ROWS", 300)
    got = {r.k: r for r in stats.adf_test(d, BY, 20).collect()}
    for k, part in (("a", y[np.arange(3000) % 3 > 0]), ("b", y[::3])):
        assert (got[k].lags, got[k].n) == (want[k].lags, want[k].n) and got[k].n == len(part) - 21 and got[k].statistic == pytest.approx(want[k].statistic)
        step, rows = np.diff(part), np.arange(21, len(part))
        x = np.stack([np.ones(len(rows)), part[rows - 1], *[step[rows - 1 - j] for j in range(1, got[k].lags + 1)]], axis=1)
        beta, rss = np.linalg.lstsq(x, step[rows - 1], rcond=None)[:2]
        se = np.sqrt(rss[0] / (len(rows) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        assert got[k].statistic == pytest.approx(beta[1] / se)


def test_unit_root_of_many_rows_and_lags(spark):
    """A bound of 126 lags: 8 256 sums of products a row, if each is an aggregate of its own (the key itself stops at 60)."""
    d = spark.range(60_000).select(F.lit("a").alias("k"), F.col("id").alias("ts"), F.col("id").alias("seq"), F.rand(3).alias("value"))
    start = time.time()
    r = stats.adf_test(d, BY, 126).first()
    assert r.stationary and r.n == 60_000 - 61 and time.time() - start < 90


def test_arrow_export_has_no_limit_of_rows(spark, tmp_path):
    from tidemark.sources import io

    d = spark.range(25_000).select("id", F.concat(F.lit("é"), "id").alias("s"), F.when(F.col("id") % 7 > 0, F.col("id") / 3).alias("x"), F.array("id").alias("a"))
    io.export_arrow_parts(d, f"{tmp_path}/parts")
    files = spark.read.parquet(f"{tmp_path}/parts")
    assert files.agg(F.sum("rows")).first()[0] == 25_000 and files.count() > 2
    back = io.read_arrow_parts(spark, f"{tmp_path}/parts", d.schema)
    assert back.schema == d.schema and back.exceptAll(d).isEmpty() and d.exceptAll(back).isEmpty()
