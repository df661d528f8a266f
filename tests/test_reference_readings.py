"""Values worked out by hand or by brute force for the operators' less obvious rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import capacity, grid, ledger, ml, probability, query, ranks, sliced, stats, timeseries
from tidemark.schema import OBS_SCHEMA
from tidemark.sources import io, scratch
from tidemark.streaming import jobs

BY = ["metric_id"]


def obs(spark, points, metric="m", labels=None, signal="raw"):
    rows = [(int(t), metric, "metric", signal, float(v), labels[i] if labels else {"host": "a"}, None, i) for i, (t, v) in enumerate(points)]
    return spark.createDataFrame(rows, OBS_SCHEMA)


def brute_grid(values, bits):
    """The sieve with growth a segment, in plain Python."""
    lo, hi = min(values), max(values)
    cells = [min(max(int((v - lo) / (hi - lo) * 2**bits), 0), 2**bits - 1) for v in values]
    level, last, growth = 0, 0, 0.0
    for i in range(bits + 1):
        x = sum(abs((a >> (bits - i)) - (b >> (bits - i))) for a, b in zip(cells, cells[1:], strict=False))
        now = 0.0 if i == 0 else (x - last) / (len(values) - 1)
        if i >= 2 and now > growth * 1.3 and now >= 0.02 and growth > 0:
            break
        level, last, growth = i, x, now
    return (hi - lo) / 2**level, level


def test_grid_growth_is_a_segments(spark):
    values = [0.0] * 500 + [0.3] + [1.0] * 500 + [0.4, 0.6] * 2 + [0.1] * 300
    g = grid.fit_values(obs(spark, enumerate(values)), BY, max_bit=8).first()
    assert (g.step, g.level, g.max_bit) == (0.0625, 4, 8) == (*brute_grid(values, 8), 8)
    rng = np.random.default_rng(5)
    for _ in range(2):
        walk = np.cumsum(rng.standard_normal(300)).tolist()
        g = grid.fit_values(obs(spark, enumerate(walk)), BY, max_bit=6).first()
        assert (pytest.approx(g.step), g.level) == brute_grid(walk, 6)


def test_pnl_is_percent_a_trade(spark):
    rows = [(1, "a", "closed", "long", 100.0, 0.02), (2, "b", "closed", "short", 50.0, 0.04), (3, "c", "closed", "long", 10.0, -0.01), (4, "d", "closed", "long", 0.0, -0.03), (5, "e", "closed", "long", 7.0, None), (6, "f", "open", "long", 5.0, None), (7, "g", "void", "long", 5.0, 0.5)]
    d = spark.createDataFrame(rows, "ts long, order_id string, status string, dtype string, size double, pnl_pct double")
    t = ledger.pnl_total(d).first()
    assert (t.trades, t.wins, t.losses, t.longs, t.shorts, t.open_count, t.zero_size_rows) == (5, 2, 3, 4, 1, 1, 1)
    assert (t.avg_win_pct, t.avg_loss_pct, t.net_pnl_pct) == pytest.approx((0.03, -0.04 / 3, 0.02 / 5))
    assert (t.gross_profit, t.gross_loss, t.net_pnl_abs) == pytest.approx((4.0, -0.1, 3.9))


def test_exhaustion_starts_at_the_current_value(spark):
    d = obs(spark, enumerate([*range(9), 15]))
    slope = np.polyfit(np.arange(10), [*range(9), 15], 1)[0]
    r = capacity.time_to_exhaustion(d, BY, 20.0).first()
    assert r.status == "PROJECTED" and r.steps_left == pytest.approx(5 / slope) == pytest.approx(3.77, abs=0.01)
    rate = np.polyfit(np.arange(10), np.log(np.array([*range(9), 15]) + 1e-10), 1)[0]
    assert capacity.time_to_exhaustion(d, BY, 20.0, "exponential").first().steps_left == pytest.approx(math.log(20 / 15) / rate)
    assert capacity.time_to_exhaustion(d, BY, 15.0).first().status == "ALREADY_EXCEEDED"
    assert capacity.projection(d, BY, [0.5]).first().value == pytest.approx(15 + slope * 43_200)


def test_arima_path_and_band(spark):
    rng = np.random.default_rng(7)
    e = rng.standard_normal(1500)
    y = [0.0]
    for i in range(1, 1500):
        y.append(0.5 * y[-1] + e[i] + 0.4 * e[i - 1])
    d = obs(spark, enumerate(y))
    m = stats.arima(d, BY, (1, 0, 1)).first()
    assert m.beta[1] == pytest.approx(0.5, abs=0.1) and m.beta[2] == pytest.approx(0.4, abs=0.1) and m.sigma2 == pytest.approx(1.0, abs=0.1)
    got = stats.arima_forecast(d, BY, (1, 0, 1), 4).orderBy("step").collect()
    lb, last = np.array(m.long_beta), np.array(y)
    shock = last[-1] - lb[0] - sum(lb[i] * last[-1 - i] for i in range(1, len(lb)))
    want = [m.beta[0] + m.beta[1] * last[-1] + m.beta[2] * shock]
    for _ in range(3):
        want.append(m.beta[0] + m.beta[1] * want[-1])
    assert [r.forecast for r in got] == pytest.approx(want)
    psi = [1.0, m.beta[1] + m.beta[2]]
    psi += [psi[1] * m.beta[1], psi[1] * m.beta[1] ** 2]
    half = [1.959963984540054 * math.sqrt(m.sigma2 * sum(p * p for p in psi[: h + 1])) for h in range(4)]
    assert [r.high - r.forecast for r in got] == pytest.approx(half)
    walk = stats.arima_forecast(obs(spark, enumerate(np.cumsum(e))), BY, (0, 1, 0), 3).orderBy("step").collect()
    assert [(r.high - r.forecast) / (walk[0].high - walk[0].forecast) for r in walk] == pytest.approx([1, math.sqrt(2), math.sqrt(3)])


def test_partial_autocorrelation_equals_regressions(spark):
    rng = np.random.default_rng(8)
    y = rng.standard_normal(400)
    y[1:] += 0.5 * y[:-1]
    got = [r.pacf for r in stats.pacf(obs(spark, enumerate(y)), BY, 3).orderBy("lag").collect()]
    x = y - y.mean()
    r = np.array([(x[k:] * x[: len(x) - k]).sum() for k in range(4)]) / (x * x).sum()
    for k in (1, 2, 3):
        toeplitz = r[np.abs(np.subtract.outer(range(k), range(k)))]
        assert got[k] == pytest.approx(np.linalg.solve(toeplitz, r[1 : k + 1])[-1])


def test_adf_statistic_and_p_value(spark):
    rng = np.random.default_rng(9)
    y = np.cumsum(rng.standard_normal(200))
    got = stats.adf_test(obs(spark, enumerate(y)), BY, max_lag=2).first()
    d = np.diff(y)
    best = None
    for p in range(3):
        x = np.column_stack([np.ones(197), y[2:-1], *[d[2 - k : -k] for k in range(1, p + 1)]])
        beta, rss = np.linalg.lstsq(x, d[2:], rcond=None)[:2]
        s = float(rss[0])
        t = beta[1] / math.sqrt(s / (197 - 2 - p) * np.linalg.inv(x.T @ x)[1, 1])
        aic = 197 * math.log(s / 197) + 2 * (2 + p)
        if best is None or aic < best[0]:
            best = (aic, t, p)
    assert got.statistic == pytest.approx(best[1]) and got.lags == best[2] and got.n == 197
    assert 0.05 < got.p_value <= 1 and not got.stationary
    assert stats._adf_p(-2.86154) == pytest.approx(0.05, abs=0.003) and stats._adf_p(-3.43035) == pytest.approx(0.01, abs=0.002) and stats._adf_p(5.0) == 1.0
    assert stats.adf_test(obs(spark, enumerate(y[:9])), BY).count() == 0 and stats.adf_test(obs(spark, enumerate(y[:10])), BY).count() == 1


@pytest.mark.parametrize("dist", ["gamma", "weibull", "beta", "lognorm"])
def test_likelihood_fits(spark, dist):
    rng = np.random.default_rng(10)
    x = {"gamma": rng.gamma(2.0, 3.0, 3000), "weibull": 4 * rng.weibull(1.7, 3000), "beta": rng.beta(2.0, 5.0, 3000), "lognorm": rng.lognormal(1.0, 0.5, 3000)}[dist]
    want = {"gamma": (2.0, 3.0), "weibull": (1.7, 4.0), "beta": (2.0, 5.0), "lognorm": (1.0, 0.5)}[dist]
    r = stats.fit_distribution(obs(spark, enumerate(x)), BY, dist).first()
    assert (r.a, r.b) == pytest.approx(want, rel=0.08) and r.fits_well
    if dist in ("gamma", "weibull", "beta"):  # the fit beats its neighbours
        def score(a, b):
            if dist == "gamma":
                return ((a - 1) * np.log(x) - x / b - a * math.log(b) - math.lgamma(a)).sum()
            if dist == "weibull":
                return (math.log(a / b) + (a - 1) * np.log(x / b) - (x / b) ** a).sum()
            return ((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)).sum()

        assert all(score(r.a, r.b) >= score(r.a * f, r.b * g) - 1e-6 for f in (0.99, 1, 1.01) for g in (0.99, 1, 1.01))


def test_distribution_functions():
    x = np.linspace(0.01, 0.99, 25)
    for a, b in ((2.0, 5.0), (0.5, 0.5), (30.0, 3.0)):
        t = (np.arange(200_000) + 0.5) / 200_000
        density = np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / 200_000
        assert np.allclose(stats._beta_cdf(x, a, b), np.interp(x, t + 0.5 / 200_000, np.cumsum(density)), atol=3e-3)
    assert np.allclose(stats._gamma_cdf(np.array([0.0, 1.0, 2.0, 30.0]), 1.0), 1 - np.exp([-0.0, -1.0, -2.0, -30.0]))
    assert stats._digamma(1.0) == pytest.approx(-0.5772156649) and stats._trigamma(1.0) == pytest.approx(math.pi**2 / 6)


@pytest.mark.parametrize("whole", [0, 10_000])
def test_order_statistics_equal_sorting(spark, whole):
    rng = np.random.default_rng(11)
    keys = {"many": rng.standard_normal(3000), "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0])}
    d = spark.createDataFrame([(k, float(v)) for k, vs in keys.items() for v in vs] + [("none", None)], "metric_id string, value double")
    if whole == 0:  # brackets decide: keys large enough for the approximation's guarantee
        d = d.where("metric_id IN ('many', 'ties')")
    qs = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 0.999, "e": 1.0} if whole else {"c": 0.5, "b": 0.3}
    found = {r.metric_id: r for r in ranks.order_statistics(d, BY, {n: (q, ranks.linear(q)) for n, q in qs.items()}, whole=whole or 400).collect()}
    for k, r in found.items():
        assert [r[n] for n in qs] == pytest.approx([np.quantile(keys[k], q) for q in qs.values()])
    assert set(found) == ({"many", "ties"} if whole == 0 else set(keys))


def test_row_slices_equal_plain_windows(spark, monkeypatch):
    rng = np.random.default_rng(12)
    y = rng.standard_normal(300)
    d = obs(spark, [(int(t), v) for t, v in zip(np.sort(rng.integers(0, 500_000, 300)), y, strict=True)])
    cut = sliced.with_row_halo(d, BY, 3, 2, rows=16)
    assert cut.select("slice").distinct().count() > 5 and cut.where("own").count() == 300
    got = {r.seq: (r.a, r.b) for r in sliced.lags(d, BY, {"a": ("value", 3), "b": ("value", -2)}).collect()}
    assert got == {i: (float(y[i - 3]) if i >= 3 else None, float(y[i + 2]) if i + 2 < 300 else None) for i in range(300)}


def test_spearman_and_bootstrap(spark):
    rng = np.random.default_rng(13)
    x = rng.integers(0, 30, 400).astype(float)
    y = x * x + rng.integers(0, 50, 400)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")

    def rank(v):
        return np.array([np.mean(np.flatnonzero(np.sort(v) == a)) for a in v])

    got = {(r.x, r.y): r["corr"] for r in stats.corr_matrix(d, ["x", "y"], "spearman").collect()}
    assert got["x", "y"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    o = obs(spark, enumerate(rng.normal(10, 2, 600)))
    one = probability.confidence_interval(o, BY, method="bootstrap", resamples=300).first()
    other = probability.confidence_interval(o.repartition(7), BY, method="bootstrap", resamples=300).first()
    t = probability.confidence_interval(o, BY, method="t").first()
    assert (one.low, one.high) == pytest.approx((other.low, other.high)) and (one.low, one.high) == pytest.approx((t.low, t.high), abs=0.06)


def test_one_open_order_per_level(spark):
    rng = np.random.default_rng(14)
    entries, exits = [], []
    for i in range(80):
        unlock = int(rng.integers(0, 60))
        bar = None if rng.random() < 0.1 else unlock + int(rng.integers(0, 12))
        entries.append(("m", f"o{i:02d}", int(rng.integers(0, 3)), unlock))
        exits.append(("m", f"o{i:02d}", bar))
    want, free = set(), {}
    for _, oid, level, unlock in sorted(entries, key=lambda e: (e[3], e[1])):
        if unlock > free.get(level, -1):
            bar = dict((x[1], x[2]) for x in exits)[oid]
            want.add(oid)
            free[level] = 10**9 if bar is None else bar
    e = spark.createDataFrame(entries, "metric_id string, order_id string, level int, unlock_seq long")
    x = spark.createDataFrame(exits, "metric_id string, order_id string, bar long")
    assert {r.order_id for r in ledger.one_open_per_level(e, x, BY).collect()} == want


def test_replay_of_a_log(spark):
    def step(seq, review):
        return {"kind": "trading_step", "candle_seq": str(seq), "next_review": str(review), "candle_id": "3"}

    def order(oid, status, level, **more):
        return {"order_id": oid, "status": status, "dtype": "long", "grid": "0", "level": str(level), "size": "1", **more}

    labels = [step(5, 100), {"kind": "plan", "grids": "[1]"}, order("a", "open", 1), order("b", "open", 1), order("c", "open", 2), order("c", "closed", 2, pnl_pct="0.1"), {"order_id": "x", "status": "open"}, {"kind": "plan", "grids": "nonsense"}, step(9, 50), {"kind": "plan", "grids": "[2]"}]
    signals = ["summary", "summary", *["order"] * 5, "summary", "summary", "summary"]
    rows = [(i, "m", "metric", s, 10.0, lab, None, i) for i, (lab, s) in enumerate(zip(labels, signals, strict=True))]
    got = ledger.replay(spark.createDataFrame(rows, OBS_SCHEMA), BY)
    assert [r.order_id for r in got["open"].collect()] == ["b"] and [r.order_id for r in got["history"].collect()] == ["c"] and got["faults"].count() == 1
    c = got["cursor"].first()
    assert (c.candle_seq, c.candle_ts, c.next_review, c.candle_id) == (9, 8, 50, 3) and got["plan"].first().grids == "[2]"


def test_orders_read(spark):
    labels = [{"order_id": "a", "status": "open", "dtype": "long", "size": "1"}, {"kind": "trading_step"}, {"order_id": "a", "status": "closed", "dtype": "long", "size": "1", "pnl_pct": "0.1"}, {"order_id": "b", "status": "open", "dtype": "long", "size": "2"}, {"host": "x"}]
    rows = [(i, "m", "metric", "order" if "order_id" in lab else "summary", 10.0, lab, None, i) for i, lab in enumerate(labels)]
    d = spark.createDataFrame(rows, OBS_SCHEMA)
    found = ledger.orders(d, now=100, lo=0, status="open", interval="1h", mark=11.0)
    assert [(r.ts, r.labels.get("order_id")) for r in found["rows"].collect()] == [(3, "b"), (1, None)]
    m = found["meta"].first()
    assert (m.scanned, m.truncated, m.complete) == (5, False, True) and found["pnl"].first().open_count == 1 and found["unrealized"].first().unrealized == pytest.approx(2 * (0.1 - 0.0004))
    assert not ledger.orders(d, now=2_000_000, lo=0, block_secs=5)["meta"].first().complete
    assert ledger.orders(d, now=100, lo=0, interval="1h")["pnl"].first().trades == 1
    with pytest.raises(ValueError):
        ledger.orders(d, now=100, limit=0)


def test_stations_on_disk(spark, tmp_path):
    d, path = obs(spark, [(60 * i, i) for i in range(30)]), str(tmp_path / "s")
    for _ in range(3):
        io.write_station(d, path, "a", 600)
    io.write_station(d, path, "b", 600)
    assert io.read_station(spark, path, "a").count() == 30
    assert io.retain(spark, path, 700, 600) == [("a", 0), ("b", 0)] and io.read_station(spark, path, "a").count() == 20
    io.invalidate_station(spark, path, "a", 1500, 600)
    assert sorted(r.ts for r in io.read_station(spark, path, "a").collect()) == list(range(600, 1500, 60))
    assert io.clear_station(spark, path, "a") == "metric" and io.read_station(spark, path, "a").count() == 0 and io.read_station(spark, path, "b").count() == 20
    assert io.clear_all_stations(spark, path) == ["b"]
    with pytest.warns(UserWarning, match="blocks"):
        query.query_recent(io.with_blocks(d, "a", 1), 0, 100_000, block_secs=1)
    n = io.export_arrow(d.select("ts", "value"), str(tmp_path / "x.arrow"))
    assert n == 30
    with pytest.raises(ValueError):
        io.export_arrow(d, str(tmp_path / "y.arrow"), max_rows=5)


def test_scratch_needs_a_shared_folder_off_local_masters(spark, monkeypatch):
    class Conf:
        def get(self, key):
            return None

    class Context:
        applicationId, master = "elsewhere", "spark://x:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch.scratch_path(Session(), "t")
    assert spark.sparkContext.applicationId in scratch.scratch_path(spark, "t")


def test_capture_and_print(spark, tmp_path, capsys):
    d = obs(spark, [(i, i) for i in range(20)])
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    assert jobs_capture(s) == 7
    io.print_sink(d.select("ts").limit(1))
    assert "ts" in capsys.readouterr().out
    with pytest.raises(ValueError):
        io.capture_sink(s, "none", 0)


def jobs_capture(stream):
    return io.capture_sink(stream, "captured", 7).count()


def test_volume_candles_fold_late_ticks(spark, tmp_path):
    rows = [("m", t, i, float(v), 2.0) for i, (t, v) in enumerate([(0, 5), (30, 7), (65, 1), (10, 9), (130, 2)])]
    df = spark.createDataFrame(rows, "metric_id string, ts long, seq long, value double, quantity double")
    for i, part in enumerate((df.where("seq < 3"), df.where("seq >= 3"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    s = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [tuple(r) for r in jobs.run_to_table(jobs.volume_candles(s, BY, 60)).orderBy("t").collect()]
    assert got == [("m", 0, 5.0, 7.0, 5.0, 7.0, 4.0), ("m", 60, 1.0, 9.0, 1.0, 9.0, 4.0)]


def test_rolling_moments_are_corrected(spark):
    y = np.random.default_rng(15).gamma(1.0, 1.0, 40)
    r = stats.rolling(obs(spark, [(i, v) for i, v in enumerate(y)]), BY, 10, ["skew", "kurt", "quantile"], q=0.2).where("ts = 39").first()
    x, n = y[-10:], 10
    m2, m3, m4 = (((x - x.mean()) ** k).mean() for k in (2, 3, 4))
    g1, g2 = m3 / m2**1.5, m4 / m2**2 - 3
    assert r.rolling_skew == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    assert r.rolling_kurt == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    assert r.rolling_quantile == pytest.approx(np.quantile(x, 0.2))


def test_floor_ranks_and_gaps(spark):
    d = obs(spark, [(t, t) for t in (0, 1, 3, 6, 10, 20)])
    assert timeseries.quantile(d, BY, 0.7).first().quantile == 6.0 and timeseries.median_gap(d, BY).first().median_gap == 3


def test_scaler_none_keeps_features(spark):
    d, _ = ml.prepare(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), None)
    assert ml.scaled(d, "none").select(F.col("scaled") == F.col("features")).first()[0]
