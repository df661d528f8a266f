"""Barriers over many blocks, sweeps and chains of entries, against plain walks."""

import random

import numpy as np
import pytest

from tidemark.operators import barriers, ledger, sliced

BY = ["k"]


def walk_bars(n, seed):
    rng = random.Random(seed)
    price, rows = 100.0, []
    for i in range(n):
        o = price
        price = max(1.0, price * (1 + rng.gauss(0, 0.02)))
        h, low = max(o, price) * (1 + abs(rng.gauss(0, 0.005))), min(o, price) * (1 - abs(rng.gauss(0, 0.005)))
        if i not in (40, 41, 42):  # a gap
            rows.append((i + 7, o, h, low, price))
    return rows


def plain_exit(bars, dtype, entry, sl, tp, unlock):
    for bar, o, h, low, _ in bars:
        if bar < unlock:
            continue
        sign = 1 if dtype == "long" else -1
        stop, hit = (low <= sl, h >= tp) if sign > 0 else (h >= sl, low <= tp)
        if stop or hit:
            fill = (min(o, sl) if sign > 0 else max(o, sl)) if stop else (max(o, tp) if sign > 0 else min(o, tp))
            return bar, "sl" if stop else "tp", (fill - entry) / entry * sign - ledger.FEE_ROUNDTRIP
    return None, "open", None


def data(spark):
    series = {"a": walk_bars(150, 1), "b": walk_bars(60, 2)}
    bars = spark.createDataFrame([(k, *r[:4]) for k, rs in series.items() for r in rs], "k string, bar bigint, o double, h double, l double")
    entries = [(k, f"{k}{r[0]}", "long" if r[0] % 2 else "short", r[4], r[0] + 1) for k, rs in series.items() for r in rs]
    return series, bars, entries


def test_first_of_extremes():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        low, high = rng.random(n), 1 + rng.random(n)
        s, a, b = rng.integers(0, n + 2, 50), rng.random(50) * 0.3, 2 - rng.random(50) * 0.3
        want = [next((i for i in range(min(x, n), n) if low[i] <= p or high[i] >= q), n) for x, p, q in zip(s, a, b, strict=True)]
        assert barriers.Extremes(low, high).first(s, a, b).tolist() == want


@pytest.mark.parametrize("block", [6, 1000])
def test_exits_and_sweep_equal_plain_walks(spark, monkeypatch, block):
    monkeypatch.setattr(barriers, "BLOCK_BARS", block)
    monkeypatch.setattr(barriers, "GROUP_POSITIONS", 5)
    series, bars, entries = data(spark)
    sets = {"tight": (0.01, 0.02), "wide": (0.1, 0.15), "never": (0.9, 5.0)}
    e = spark.createDataFrame([(*r, r[3] * (0.95 if r[2] == "long" else 1.05), r[3] * (1.1 if r[2] == "long" else 0.9)) for r in entries] + [("a", "none", "long", 1.0, None, 0.5, 2.0), ("a", "no stop", "long", 100.0, 8, None, 101.0)],
                              "k string, order_id string, dtype string, entry double, unlock_seq bigint, sl double, tp double")
    got = {(r.k, r.order_id): (r.bar, r.reason, r.pnl_pct) for r in ledger.barrier_exit(e, bars, BY, max_bars=2).collect()}
    for k, oid, dtype, entry, unlock in entries:
        sl, tp = (0.95, 1.1) if dtype == "long" else (1.05, 0.9)
        bar, reason, pnl = plain_exit(series[k], dtype, entry, entry * sl, entry * tp, unlock)
        assert got[k, oid][:2] == (bar, reason) and got[k, oid][2] == (pnl if pnl is None else pytest.approx(pnl)), oid
    assert got["a", "none"][1] == "open" and got["a", "no stop"][1] == "tp"
    params = spark.createDataFrame([(n, *v) for n, v in sets.items()], "param string, sl_pct double, tp_pct double")
    windows = {"early": (0, 60), "late": (60, 10_000)}
    swept = {(r.param, r.window): (r.trades, r.open, r.score) for r in ledger.param_sweep(e.where("order_id <> 'no stop'"), bars, BY, params, max_bars=2, windows=windows).collect()}
    for name, (s, t) in sets.items():
        for window, (lo, hi) in windows.items():
            res = [plain_exit(series[k], d, p, p * (1 - (1 if d == "long" else -1) * s), p * (1 + (1 if d == "long" else -1) * t), u)[2] for k, _, d, p, u in entries if lo <= u < hi]
            done = [x for x in res if x is not None]
            assert swept[name, window][:2] == (len(done), len(res) - len(done))
            assert swept[name, window][2] == pytest.approx(np.mean(done) if done else 0.0)


@pytest.mark.parametrize("rows", [10**6, 10])
def test_chain_of_entries_equals_a_walk(spark, monkeypatch, rows):
    monkeypatch.setattr(sliced, "ROWS", rows)
    rng = random.Random(9)
    rows_ = []
    for i in range(300):
        unlock = rng.randrange(200)
        rows_.append((rng.choice("ab"), i % 3, f"o{i:03d}", unlock, None if rng.random() < 0.02 else unlock + rng.randrange(6)))
    want = set()
    for k in "ab":
        for lv in range(3):
            free = -1
            for _, _, oid, unlock, bar in sorted((r for r in rows_ if r[:2] == (k, lv)), key=lambda r: (r[3], r[2])):
                if unlock > free:
                    want.add(oid)
                    free = 10**9 if bar is None else bar
    e = spark.createDataFrame([r[:4] for r in rows_], "k string, level int, order_id string, unlock_seq bigint")
    x = spark.createDataFrame([(r[0], r[2], r[4]) for r in rows_], "k string, order_id string, bar bigint")
    assert {r.order_id for r in ledger.one_open_per_level(e, x, BY).collect()} == want


def test_no_bars_and_no_entries(spark):
    _, bars, entries = data(spark)
    e = spark.createDataFrame([(*entries[0], 1.0, 2.0)], "k string, order_id string, dtype string, entry double, unlock_seq bigint, sl double, tp double")
    assert ledger.barrier_exit(e, bars.limit(0), BY, max_bars=64).first().reason == "open"
    assert ledger.barrier_exit(e.limit(0), bars, BY, max_bars=64).count() == 0
