"""Inputs on which a bound in an operator would lose part of its results."""

import random

import duckdb
import pytest

from tidemark.operators import ledger, text
from tidemark.plans import queries as Q

BY = ["metric_id"]


@pytest.mark.parametrize("name", ["stream_candles", "stream_sliding", "stream_sessions"])
def test_streams_read_many_unsorted_files_whole(spark, sf_dir, tmp_path, name):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(16).write.parquet(f"{tmp_path}/events.parquet")  # every file spans the whole period
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = Q.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({Q.ORACLES[name]})").fetchall()

    def norm(rows):
        return sorted(tuple(round(float(x), 4) if isinstance(x, int | float) else str(x) for x in r) for r in rows)

    rows = got.collect()
    assert len(rows) == len(want)
    assert norm(map(tuple, rows)) == norm(want)


ENTRY = "metric_id string, order_id string, dtype string, entry double, unlock_seq long, sl double, tp double"
BAR = "metric_id string, bar long, o double, h double, l double"


def test_exits_at_any_distance(spark):
    rng = random.Random(5)
    bars = []
    for m in ("a", "b"):
        price = 100.0
        for i in range(3, 400):
            price *= 1 + rng.uniform(-0.01, 0.01) if m == "a" else 1 + rng.uniform(-0.0005, 0.0005)
            bars.append((m, i, price, price * 1.002, price * 0.998))
    entries = []
    for m, i, o, _, _ in bars[::3]:
        side = rng.choice(["long", "short"])
        sl, tp = (0.97, 1.04) if side == "long" else (1.03, 0.96)
        entries.append((m, f"{m}{i}", side, o, i + 1, o * sl, o * tp))
    entries.append(("a", "early", "long", 100.0, -50, 97.0, 104.0))
    want = {}
    for m, name, side, _, unlock, sl, tp in entries:
        want[name] = (None, "open")
        for b, i, _, h, low in bars:
            if b == m and i >= unlock and (low <= sl or h >= tp if side == "long" else h >= sl or low <= tp):
                want[name] = (i, "sl" if (low <= sl if side == "long" else h >= sl) else "tp")
                break
    assert any(bar > 80 + int(name[1:]) for name, (bar, _) in want.items() if bar and name != "early")
    e, c = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(bars, BAR)
    for block in (5, 64):
        got = {r.order_id: (r.bar, r.reason) for r in ledger.barrier_exit(e, c, BY, max_bars=block).collect()}
        assert got == want


def test_sweep_takes_all_parameters(spark):
    bars = spark.createDataFrame([("m", i, 100.0, 100.0 + (i == 90), 100.0) for i in range(1, 91)], BAR)
    e = spark.createDataFrame([("m", "1", "long", 100.0, 2, 0.0, 0.0)], ENTRY)
    params = spark.range(10_500).selectExpr("cast(id AS string) AS param", "0.5D AS sl_pct", "0.01D AS tp_pct")
    assert ledger.param_sweep(e, bars, BY, params, max_bars=64).count() == 10_500


def test_short_patterns_are_all_tested(spark):
    words = [f"{i:05d}" for i in range(10_050)] + ["x", "\U0001f600"]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a 00007 b"), (3, None)], "doc_id long, text string")
    patterns = spark.createDataFrame([(w,) for w in words], "pattern string")
    got = text.pattern_hits(docs, patterns, "doc_id").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 10_052, 2: 1}
