"""Hand-computed values, invariants and SQL comparisons of the time-series operators."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import anomaly, candles, capacity, forecast, grid, indicators, ledger, ml, probability, query, sliced, stats, text, timeseries, trend
from tidemark.plans import queries as Q
from tidemark.plans import registry, source_queries  # noqa: F401  (registers its queries)
from tidemark.schema import OBS_SCHEMA
from tidemark.sources import io
from tidemark.streaming import jobs

BY = ["metric_id"]


def obs(spark, points, metric="m"):
    rows = [(int(t), metric, "metric", "raw", float(v), {"host": "a"}, None, i) for i, (t, v) in enumerate(points)]
    return spark.createDataFrame(rows, OBS_SCHEMA)


@pytest.fixture(scope="module")
def ten(spark):
    return obs(spark, [(60 * i, i) for i in range(10)])


def one(df):
    return df.first()


def test_hand_values(spark, ten):
    assert one(timeseries.rate(ten, BY)).rate == pytest.approx(1 / 60)
    ma = {r.ts: r.moving_avg for r in timeseries.moving_avg(ten, BY, 120).collect()}
    assert len(ma) == 10 and ma[0] == 0 and ma[60] == 0.5 and ma[540] == 8
    assert timeseries.resample(ten, BY, 120).count() == 5
    assert one(timeseries.quantile(ten, BY, 0.5)).quantile == 4.5
    assert one(timeseries.p95(ten, BY)).quantile == 8.0 and one(timeseries.p99(ten, BY)).quantile == 8.0
    assert timeseries.delta(ten, BY).count() == 9 and timeseries.pct_change(ten, BY).count() == 9
    assert one(timeseries.pct_change(ten, BY).where("ts = 60")).pct_change == 0.0
    assert one(timeseries.median_gap(ten, BY)).median_gap == 60 and one(timeseries.sampling_interval(ten, BY)).interval == 60


def test_empty_and_single(spark, ten):
    empty = ten.limit(0)
    for df in (timeseries.rate(empty, BY), timeseries.moving_avg(empty, BY, 60), timeseries.delta(empty, BY), timeseries.quantile(empty, BY, 0.9), trend.trend_fit(empty, BY), candles.tick_to_candle(empty, BY, 60)):
        assert df.count() == 0
    single = ten.limit(1)
    assert one(timeseries.rate(single, BY)).rate is None
    assert one(timeseries.summary_stats(single, BY)).variance == 0.0 and one(timeseries.median_gap(single, BY)).median_gap == 60


def test_slices_equal_plain_windows(spark):
    rng = np.random.default_rng(1)
    pts = sorted((int(t), float(v)) for t, v in zip(rng.integers(-300_000, 900_000, 400), rng.standard_normal(400), strict=True))
    d = obs(spark, pts)
    got = {r.seq: (r.p, r.s) for r in sliced.with_running(sliced.with_lag(d, BY, {"p": "value"}), BY, {"s": F.col("value")}).collect()}
    total, before = 0.0, None
    for i, (_, v) in enumerate(pts):
        total += v
        assert got[i][0] == before and got[i][1] == pytest.approx(total)
        before = v


def test_grid_values(spark):
    flat = obs(spark, [(i, 5.0) for i in range(50)])
    g = one(grid.fit_values(flat, BY, max_bit=10))
    assert g.step == 1.0
    wave = obs(spark, [(60 * i, 30 + i % 50) for i in range(500)]).withColumn("gmin", F.lit(0.0)).withColumn("gmax", F.lit(100.0))
    fitted = grid.grid_fit(wave, BY, max_bit=8)
    r = one(fitted)
    assert 1 <= r.num_cells <= 256 and r.step * r.num_cells >= 100
    moves = grid.transitions(grid.dominant_cells(wave, BY, fitted, 600), BY)
    p = one(grid.move_probabilities(moves, BY))
    assert p.up + p.down + p.stay == pytest.approx(1.0)
    two = obs(spark, [(0, 0.5), (30, 0.5), (60, 2.5), (90, 2.5)])
    g4 = spark.createDataFrame([("m", 1.0, 0.0, 0.0, 4.0, 2, 4)], "metric_id string, step double, offset double, gmin double, gmax double, max_bit int, num_cells int")
    d = grid.dominant_cells(two, BY, g4, 60)
    assert d.count() == 2 and one(grid.move_probabilities(grid.transitions(d, BY), BY)).up == 1.0
    gap = grid.dominant_cells(obs(spark, [(0, 0.5), (130, 0.5)]), BY, g4, 60)
    assert [x.cell for x in gap.orderBy("bucket").collect()] == [0, 3, 0]
    mass = grid.n_step(grid.transitions(gap, BY), BY, spark.createDataFrame([("m", 0)], "metric_id string, cell long"), 3)
    assert one(mass.agg(F.sum("mass"))).asDict().popitem()[1] == pytest.approx(1.0)


def test_plan_from_grid(spark, sf_dir):
    p = Q.QUERIES["plan_from_grid"](spark, sf_dir)
    for r in p.groupBy("metric_id").agg(F.sum("weight").alias("w"), F.min("long_p").alias("lo"), F.max("short_p").alias("hi")).collect():
        assert r.w == pytest.approx(1.0, abs=1e-4) and r.lo >= 0.25 and r.hi <= 0.75
    a = Q.QUERIES["absorption_probability"](spark, sf_dir).collect()
    assert a and all(0 <= r.top + r.bottom <= 2 for r in a)
    x = spark.range(1).select(ledger.max_levels_for_profit(F.lit(100.0), F.lit(110.0), 0.01).alias("n"), ledger.min_profitable_step(F.lit(100.0), 0.01).alias("s")).first()
    assert x.n == 5 and x.s == 2.0


def test_capacity_order_of_arrival(spark):
    pts = [(900 * i, 50 + 0.4 * i * 0.25 + 3 * abs((i / 16) % 2 - 1)) for i in range(97)]
    r = one(trend.capacity_forecast(obs(spark, pts), BY, 200.0, interval_secs=3600))
    assert r.direction == "rising" and 0 <= r.hours_to_top_cell <= r.hours_to_full <= r.hours_to_trend_full
    falling = one(trend.capacity_forecast(obs(spark, [(t, 300 - v) for t, v in pts]), BY, 400.0, interval_secs=3600))
    assert falling.direction == "falling" and falling.hours_to_full is None
    assert [x.value for x in trend.capacity_report(trend.capacity_forecast(obs(spark, [(t, 300 - v) for t, v in pts]), BY, 400.0), BY).collect()] == [-1.0] * 3


def test_candles(spark):
    d = obs(spark, [(0, 5), (10, 7), (59, 3), (60, 4), (-5, 2)])
    c = {r.t: (r.o, r.h, r.l, r.c, r.v) for r in candles.tick_to_candle(d, BY, 60).collect()}
    assert c == {0: (5, 7, 3, 3, 3), 60: (4, 4, 4, 4, 1), -60: (2, 2, 2, 2, 1)}
    t = spark.createDataFrame([(4 * 86_400 - 3600 + 86_400,)], "t long")  # Monday 1970-01-05 less an hour ... Friday checks below
    assert t.count() == 1
    friday = 1 * 86_400 + 23 * 3600  # Friday 1970-01-02 23:00
    x = spark.createDataFrame([(friday,)], "t long").select(candles.calendar_next(F.col("t"), "forex", 3600).alias("n"), candles.calendar_next(F.col("t"), "crypto", 3600).alias("c")).first()
    assert x.n == 4 * 86_400 and x.c == friday + 3600


def test_pnl_totals_are_sums_of_buckets(spark, sf_dir):
    led = Q.ledger_table(spark, sf_dir)
    b = ledger.pnl_buckets(led, 604_800).agg(F.sum("net_pnl_abs").alias("x"), F.sum("trades").alias("n")).first()
    t = ledger.pnl_total(led).first()
    assert b.x == pytest.approx(t.net_pnl_abs) and b.n == t.trades
    assert t.win_rate == pytest.approx(t.wins / t.trades)


def test_barriers(spark):
    bars = spark.createDataFrame([("m", i, float(o), float(h), float(lo), 0.0) for i, (o, h, lo) in enumerate([(100, 101, 99), (100, 112, 88), (130, 131, 129)], 1)], "metric_id string, bar long, o double, h double, l double, close double")
    e = spark.createDataFrame([("m", "both", "long", 100.0, 1, 90.0, 110.0), ("m", "gap", "long", 100.0, 3, 90.0, 110.0), ("m", "short", "short", 100.0, 2, 111.0, 50.0), ("m", "none", "long", 100.0, 1, 1.0, 999.0)], "metric_id string, order_id string, dtype string, entry double, unlock_seq long, sl double, tp double")
    got = {r.order_id: (r.bar, r.reason, r.fill) for r in ledger.barrier_exit(e, bars, BY, max_bars=2).collect()}
    assert got == {"both": (2, "sl", 90.0), "gap": (3, "tp", 130.0), "short": (2, "sl", 111.0), "none": (None, "open", None)}


def test_probability_and_stats(spark, ten):
    assert one(probability.exceedance(ten, BY, 6)).probability == pytest.approx(0.3)
    assert [r.ecdf for r in probability.ecdf(ten, BY).orderBy("value").collect()] == pytest.approx([i / 10 for i in range(1, 11)])
    assert one(probability.expected_shortfall(ten, BY, 0.9)).shortfall == 0.0
    d = one(stats.describe(ten, BY))
    assert d.mean == 4.5 and d.std == pytest.approx(np.std(range(10), ddof=1)) and d.skew == pytest.approx(0) and d.kurtosis == pytest.approx(-1.2) and d.mad == 2.5
    r = {x.lag: x.acf for x in stats.acf(ten, BY, 3).collect()}
    y = np.arange(10) - 4.5
    assert r[1] == pytest.approx((y[1:] * y[:-1]).sum() / (y * y).sum())
    k = probability.density(obs(spark, [(i, v) for i, v in enumerate(np.random.default_rng(2).standard_normal(500))]), BY, 100)
    pts = [(x["at"], x.density) for x in k.orderBy("at").collect()]
    assert np.trapezoid([p[1] for p in pts], [p[0] for p in pts]) == pytest.approx(1.0, abs=0.05)


def test_forecast_models_recover_parameters(spark):
    rng = np.random.default_rng(3)
    y = [0.0, 0.0]
    for _ in range(800):
        y.append(0.6 * y[-1] - 0.2 * y[-2] + rng.standard_normal())
    d = obs(spark, list(enumerate(y)))
    beta = one(stats.arima(d, BY, (2, 0, 0))).beta
    assert beta[1] == pytest.approx(0.6, abs=0.1) and beta[2] == pytest.approx(-0.2, abs=0.1)
    assert one(stats.adf_test(d, BY)).stationary
    assert not one(stats.adf_test(obs(spark, list(enumerate(np.cumsum(y)))), BY)).stationary
    line = obs(spark, [(i, 3 + 2 * i) for i in range(30)])
    assert [r.forecast for r in stats.arima_forecast(line, BY, (0, 1, 0), 2).orderBy("step").collect()] == pytest.approx([63, 65])
    season = obs(spark, [(i, 10 + i + [0, 5, -5, 0][i % 4]) for i in range(40)])
    s = stats.seasonal_decompose(season, BY, 4).where("trend IS NOT NULL").orderBy("ts").collect()
    assert max(abs(r.resid) for r in s) < 1e-9 and {round(r.seasonal, 6) for r in s} == {0.0, 5.0, -5.0}
    hw = one(forecast.holt_winters(line, BY, 2))
    assert hw.forecast == pytest.approx([63, 65], abs=0.5)
    assert one(stats.fit_distribution(obs(spark, list(enumerate(rng.standard_normal(400)))), BY, "norm")).fits_well


def test_capacity_models(spark):
    d = obs(spark, [(i, 1 + 2 * i + 0.5 * i * i) for i in range(20)])
    r = one(capacity.growth_rate(d, BY, "polynomial"))
    assert (r.intercept, r.slope, r.quadratic) == pytest.approx((1, 2, 0.5))
    assert one(capacity.time_to_exhaustion(obs(spark, [(i, i) for i in range(10)]), BY, 20.0)).steps_left == pytest.approx(11)
    assert one(capacity.time_to_exhaustion(obs(spark, [(i, -i) for i in range(10)]), BY, 20.0)).status == "NOT_GROWING"
    p = capacity.peaks(obs(spark, [(0, 1), (10, 9), (20, 9), (30, 1), (40, 9)]), BY, 5.0).orderBy("start").collect()
    assert [(x.start, x.end, x.duration) for x in p] == [(10, 30, 20), (40, 40, 0)]


def test_json_and_casts(spark):
    d = spark.createDataFrame([('{"a": {"b": [1, "x", {"c": true}]}, "0": "zero"}',)], "j string")

    def path(p):
        return d.select(S.json_path(F.col("j"), p)).first()[0]

    assert path(".a.b[]") == ["1", "x", '{"c":true}'] and path(".a.b[2].c") == ["true"] and path(".a.b^.b[0]") == ["1"]
    assert path(".missing") == [] and path("[0]") == ["zero"]
    c = lambda x, k: d.select(S.cast_value(F.lit(x), k)).first()[0]
    assert (c(" 7 ", "u32"), c("-1", "u32"), c("4294967296", "u32"), c("true", "i64"), c("1.5", "i64"), c("1.5", "f64")) == (7, None, None, 1, None, 1.5)
    assert (c("on", "bool"), c("off", "bool"), c("maybe", "bool"), c(None, "bool"), c(None, "string")) == (True, False, None, False, "null")
    out, err = S.render_template("x {{a}} y", {"a": F.lit("1")})
    assert d.select(out).first()[0] == "x 1 y" and d.select(err).first()[0] is None
    assert d.select(S.render_template("{{b}}", {})[1]).first()[0] == "unknown placeholder b"
    assert d.select(S.sanitize_metric_name(F.lit("12a-b"), "p_")).first()[0] == "p__a_b"


def test_time_helpers():
    now = 1_700_000_000
    assert S.parse_duration("1h30m") == 5400 and S.parse_time("now-1d", now) == now - 86_400 and S.parse_time("2h", now) == now - 7200
    assert S.parse_time("1h ago", now) == now - 3600 and S.parse_time("2023-11-14T22:13:20Z", now) == now
    with pytest.raises(ValueError):
        S.parse_duration("0s")
    lo, hi = S.time_range("last_week", now)
    assert hi - lo == 604_800 and lo % 86_400 == 0
    with pytest.raises(ValueError):
        query.check_query_bounds(0, 40 * 86_400, 10)


def test_sources(spark, tmp_path, ten):
    (tmp_path / "x.csv").write_text("t,o,h,l,c,v\n1000,1,2,0.5,1.5,10\n2000,bad,2,1,1,1\n3000,1,2\n")
    got = io.read_ohlcv_csv(spark, str(tmp_path / "x.csv"), unit_ms=1, symbol="s", resolution="1m")
    assert got.count() == 5 and {r.ts for r in got.collect()} == {1}
    msgs = ['[{"ts":1,"metric_id":"a","value":1.0}]', '{"ts":2,"metric_id":"b","value":2.0}', '{"data":[{"ts":3,"metric_id":"c","value":3.0}]}', '{"observations":{"ts":4,"metric_id":"d","value":4.0}}', '{"event":"stop"}']
    d = spark.createDataFrame([(m,) for m in msgs], "m string").select(F.explode(io.parse_observation_envelope(F.col("m"))).alias("o"))
    assert sorted(r.o.ts for r in d.collect()) == [1, 2, 3, 4]
    k = spark.createDataFrame([('[[1000,"1","2","0.5","1.5","9"],[2000,"x","2","1","1","1"]]',)], "j string")
    paths = {n: f"[][{i}]" for i, n in enumerate(("t", "o", "h", "l", "c", "v"))}
    assert io.parse_candle_json(k, "j", paths, unit_ms=1).count() == 5
    prom = '{"status":"success","data":{"resultType":"matrix","result":[{"metric":{"__name__":"up","job":"j"},"values":[[1,"1"],[2,"0"]]}]}}'
    good, failed = io.parse_prometheus(spark.createDataFrame([(prom,), ('{"status":"error"}',), ("no json",)], "j string"), "j")
    p = good.collect()
    assert sorted(r.status for r in failed.collect()) == ["error", "unreadable"]
    assert [(r.ts, r.metric_id, r.value, r.labels) for r in p] == [(1, "up", 1.0, {"job": "j"}), (2, "up", 0.0, {"job": "j"})]
    path = str(tmp_path / "lake")
    io.write_station(ten.unionByName(ten), path, "s1", 120)
    back = io.read_station(spark, path, "s1")
    assert back.count() == 10 and back.select("blk").distinct().count() == 5
    assert io.retained(back, 250, 120).count() == 6
    io.write_station(ten, path, "s1", 120, mode="overwrite")
    assert io.read_station(spark, path, "s1").count() == 10
    with pytest.raises(ValueError):
        io.write_station(ten, path, "other", 120, allowed={"s1"})
    a = io.alert_payloads(spark.createDataFrame([("x" * 5000,), ("y",)], "m string")).collect()
    assert sorted(r.accepted for r in a) == [False, True]


def test_text_and_bloom(spark):
    d = spark.createDataFrame([(1, "disk failure on node"), (2, "all fine"), (3, None)], "doc_id long, text string")
    assert [r.matched for r in text.pattern_match(d, ["failure", "x"]).orderBy("doc_id").collect()] == [True, False, False]
    many = [f"zz{i}" for i in range(300)] + ["fine"]
    assert [r.matched for r in text.pattern_match(d, many).orderBy("doc_id").collect()] == [False, True, False]
    p = spark.createDataFrame([("failure on",), ("all",), ("",)], "pattern string")
    assert {(r.doc_id, r.pattern) for r in text.pattern_hits(d, p, "doc_id").collect()} == {(1, "failure on"), (2, "all")}
    bits, k = text.bloom_size(1000, 0.01)
    b = text.bloom_build(spark.range(1000), "id", bits, k)
    r = text.bloom_contains(spark.range(2000), "id", b, bits, k).groupBy((F.col("id") < 1000).alias("in")).agg(F.avg(F.col("maybe").cast("double")).alias("p")).collect()
    rates = {x["in"]: x.p for x in r}
    assert rates[True] == 1.0 and rates[False] < 0.05


def test_learning(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), float(3 * a - 2 * b + 1)) for i, (a, b) in enumerate(rng.standard_normal((300, 2)))]
    d = spark.createDataFrame(rows, "id long, a double, b double, y double")
    _, s, w = ml.regression(d, "y", ["a", "b"], ["id"])
    assert {r.feature: round(r.weight, 6) for r in w.collect()} == {"a": 3.0, "b": -2.0} and all(r.r2 > 0.999 for r in s.collect())
    out = ml.isolation_forest(d.unionByName(spark.createDataFrame([(999, 50.0, 50.0, 0.0)], d.schema)), ["a", "b"], ["id"], trees=20)
    assert out.orderBy(F.desc("score")).first().id == 999
    pts = [(i, 0.01 * i, 0.0) for i in range(30)] + [(100 + i, 5 + 0.01 * i, 5.0) for i in range(30)] + [(500, 99.0, 99.0)]
    c = {r.id: r.cluster for r in ml.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), "x", "y", "id", eps=0.05, min_samples=3).collect()}
    assert c == {**dict.fromkeys(range(30), 0), **dict.fromkeys(range(100, 130), 100), 500: -1}
    x = obs(spark, [(i, math.sin(i / 5) + (40 if i == 350 else 0)) for i in range(400)])
    scores = anomaly.rcf_scores(x, BY, trees=10, size=128).where("ts > 200").orderBy(F.desc("score")).first()
    assert scores.ts == 350
    assert anomaly.shingle(x, BY, 3).where("shingle IS NULL").count() == 2


def test_indicators(spark):
    d = spark.createDataFrame([("m", i, float(i), float(i + 1), float(i - 1), float(i), 1.0) for i in range(1, 31)], "metric_id string, t long, o double, h double, l double, c double, v double")
    r = indicators.with_rsi(d, BY, "c", 14, 28).where("t = 30").first()
    assert r.rsi == 1.0
    g = indicators.feature_graph(d, BY, {"m3": ("ma", "c", 3), "s": ("sub", "c", "m3"), "r": ("roc", "c", 1)}).where("t = 30").first()
    assert g.m3 == 29.0 and g.s == 1.0 and g.r == pytest.approx(1 / 29)
    with pytest.raises(ValueError):
        indicators.feature_graph(d, BY, {"a": ("abs", "b"), "b": ("abs", "a")})


def test_transform_registry(spark, ten):
    @registry.transform("broken_kind")
    def broken(df, params):
        return df.withColumn("kind", F.lit("nonsense"))

    assert registry.apply("broken_kind", ten).count() == 0 and registry.apply("batch_mean", ten).first().value == 4.5
    with pytest.raises(KeyError):
        registry.apply("unknown", ten)
    registry.register_functions(spark)
    assert spark.sql("SELECT bucket_align(-1, 60) AS x").first().x == -60


def test_stream_sinks(spark, tmp_path, ten):
    ten.repartition(3).write.parquet(str(tmp_path / "in"))
    faults = str(tmp_path / "faults")
    seen = []

    def bad(df, batch):
        seen.append(batch)
        raise RuntimeError("no")

    work = jobs.tap(jobs.idempotent_writer(str(tmp_path / "out")), jobs.tolerant(bad, faults, "n1"))
    q = spark.readStream.schema(ten.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(work).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10 and seen
    assert jobs.current_faults(spark.read.parquet(faults)).first().code == "RuntimeError"


SQL_CHECKED = [
    "flagship_hourly_summary", "ts_moving_avg", "ts_p95", "tick_to_candle", "grid_fit", "grid_transitions", "trend_fit", "verify_forecast", "barrier_exit", "pnl_buckets", "peaks", "stream_candles",
    "unrealized_pnl", "time_to_exhaustion", "projection", "capacity_forecast", "risk_governor", "param_sweep", "describe", "rank_correlation", "stream_volume_candles", "write_station", "orders",
]


@pytest.mark.parametrize("name", SQL_CHECKED)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("events", "lineitem", "documents", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = Q.QUERIES[name](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({Q.ORACLES[name]})").fetchall()

    def norm(rows):
        return sorted(tuple(round(float(x), 5) if isinstance(x, int | float) and not isinstance(x, bool) else str(x) for x in r) for r in rows)

    assert norm(map(tuple, got.collect())) == norm(want)


def test_pct_change_query_is_the_quotient_of_its_sql_after_zero(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:0{i}", 1, "view", v, "{}") for i, v in enumerate([0.0, 3.0, 0.0, 0.0, -1.0, 1.0])]
    d = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    d.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = [r.pct_change for r in Q.QUERIES["ts_pct_change"](spark, str(tmp_path)).orderBy("seq").collect()]
    assert got[:2] == [math.inf, -1.0] and math.isnan(got[2]) and got[3:] == [-math.inf, 2.0]


def test_pct_change_query_rounds_ties_as_its_sql(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:0{i}", 1, "view", v, "{}") for i, v in enumerate([32.0, 65.19, 6.4, 12.81, 6.4, 0.0])]
    d = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    d.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in Q.QUERIES["ts_pct_change"](spark, str(tmp_path)).orderBy("seq").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == con.execute(f"{Q.ORACLES['ts_pct_change']} ORDER BY seq").fetchall()
    assert got[0][3] == 1.037187
