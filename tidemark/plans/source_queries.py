"""Registered queries of sources, sinks, scalar functions, stream plumbing and helpers: what is written is read back."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import anomaly, candles, capacity, exposition, ledger, ml, probability, query, stats, text, timeseries
from tidemark.plans import registry
from tidemark.plans.queries import BY, CANDLES, DAY, LEDGER, OBS, T0, _candles, _event_stream, registered, rounded
from tidemark.schema import ledger as ledger_table
from tidemark.schema import observations, table
from tidemark.sources import io
from tidemark.sources.scratch import scratch_path
from tidemark.streaming import jobs

# --- sources and sinks ------------------------------------------------------------------------------------------

_CELLS = f"WITH {CANDLES}, n AS (SELECT t AS ts, o, h, l, c, v FROM candles) SELECT ts, field, value FROM n UNPIVOT (value FOR field IN (o, h, l, c, v))"


def _cells(d: DataFrame) -> DataFrame:
    return d.select("ts", F.col("labels")["field"].alias("field"), "value")


@registered(_CELLS)
def read_ohlcv_csv(spark, sf_dir):
    path = scratch_path(spark, "ohlcv")
    _candles(spark, sf_dir).select((F.col("t") * 1000).alias("t"), "o", "h", "l", "c", "v").write.option("header", True).csv(path)
    return _cells(io.read_ohlcv_csv(spark, path, unit_ms=1, symbol="x", resolution="1h"))


@registered(_CELLS)
def parse_candle_json(spark, sf_dir):
    """Klines of a day as arrays of text."""
    row = F.array((F.col("t") * 1000).cast("string"), *[F.col(c).cast("string") for c in io.FIELDS])
    bodies = _candles(spark, sf_dir).groupBy("metric_id", F.floor(F.col("t") / DAY)).agg(F.to_json(F.collect_list(row)).alias("body"))
    paths = {n: f"[][{i}]" for i, n in enumerate(("t", *io.FIELDS))}
    return _cells(io.parse_candle_json(bodies, "body", paths, unit_ms=1, symbol="x", resolution="1h"))


_ITEM = ["ts", "metric_id", "kind", "signal", "value", "labels"]


def _hourly_items(spark, sf_dir) -> DataFrame:
    return observations(spark, sf_dir).groupBy(F.floor(F.col("ts") / 3600).alias("hour")).agg(F.collect_list(F.struct(*_ITEM)).alias("items"))


_ROWS = f"WITH {OBS} SELECT ts, metric_id, value, user_id FROM obs"


def _rows(d: DataFrame) -> DataFrame:
    return d.select("ts", "metric_id", "value", F.col("labels")["user_id"].alias("user_id"))


@registered(_ROWS)
def parse_observation_envelope(spark, sf_dir):
    """Hours of observations as plain arrays, below ``data`` and below ``data.observations``."""
    d = _hourly_items(spark, sf_dir)
    whole = F.to_json("items")
    body = F.when(F.col("hour") % 3 == 0, whole).when(F.col("hour") % 3 == 1, F.concat(F.lit('{"data":'), whole, F.lit("}"))).otherwise(F.concat(F.lit('{"data":{"observations":'), whole, F.lit("}}")))
    return _rows(d.select(F.explode(io.parse_observation_envelope(body)).alias("o")).select("o.*"))


@registered(_ROWS)
def read_observation_json(spark, sf_dir):
    path = scratch_path(spark, "bodies")
    _hourly_items(spark, sf_dir).groupBy((F.col("hour") % 24).alias("h")).agg(F.to_json(F.flatten(F.collect_list("items"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return _rows(io.read_observation_json(spark, path)[0])


@registered(f"{_ROWS} UNION ALL SELECT NULL, 'error', NULL, NULL FROM (SELECT DISTINCT ts // 3600 FROM obs)")
def parse_prometheus(spark, sf_dir):
    """Vector responses by hour, with a failed one beside each."""
    obs = observations(spark, sf_dir)
    sample = F.struct(F.create_map(F.lit("__name__"), "metric_id", F.lit("user_id"), F.col("labels")["user_id"]).alias("metric"), F.array(F.col("ts").cast("string"), F.col("value").cast("string")).alias("value"))
    hour = obs.groupBy(F.floor(F.col("ts") / 3600)).agg(F.collect_list(sample).alias("result"))
    good = F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.lit("vector").alias("resultType"), "result").alias("data")))
    samples, errors = io.parse_prometheus(hour.select(F.explode(F.array(good, F.lit('{"status":"error","error":"timeout"}'))).alias("body")), "body")
    return _rows(samples).unionByName(errors.select(F.lit(None).cast("bigint").alias("ts"), F.col("status").alias("metric_id"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("user_id")))


@registered(f"{_ROWS} WHERE ts > {T0 + DAY} AND ts <= {T0 + 3 * DAY}")
def read_block_lake(spark, sf_dir):
    path = scratch_path(spark, "lake")
    items = observations(spark, sf_dir).groupBy(F.floor(F.col("ts") / 21_600).alias("blk"), F.floor(F.col("ts") / 3600).alias("h")).agg(F.to_json(F.struct(F.collect_list(F.struct(*_ITEM)).alias("items"))).alias("value"))
    items.select("value", "blk").hint("rebalance", "blk").write.partitionBy("blk").parquet(path)
    return _rows(io.read_block_lake(spark, path, 21_600, T0 + DAY, T0 + 3 * DAY))


_DISTINCT = f"WITH {OBS} SELECT DISTINCT ts, metric_id, value, user_id FROM obs"


@registered(_DISTINCT)
def write_station(spark, sf_dir):
    """Written twice, and once more in part: stored rows stay single."""
    path, obs = scratch_path(spark, "stations"), observations(spark, sf_dir)
    for part in (obs, obs, obs.where(F.col("ts") >= T0 + 20 * DAY)):
        io.write_station(part, path, "main", DAY, allowed={"main"})
    return _rows(io.read_station(spark, path, "main"))


_KEEP, _INVALID = T0 + 3 * DAY + 3600, T0 + 10 * DAY + 5 * 3600


@registered(f"""WITH {OBS}, d AS (SELECT DISTINCT ts, metric_id, value, user_id, k FROM obs WHERE ts // {DAY} >= {_KEEP // DAY} AND ts < {_INVALID})
SELECT 'a' AS station, 'metric' AS kinds, count(*) AS rows, count(DISTINCT ts // {DAY}) AS blocks, max(ts) AS last_ts FROM d""")
def station_maintenance(spark, sf_dir):
    """Two stations: old blocks retained away, one invalidated from a time on, the other cleared."""
    path, obs = scratch_path(spark, "stations"), observations(spark, sf_dir)
    for name in ("a", "b"):
        io.write_station(obs, path, name, DAY)
    io.retain(spark, path, _KEEP, DAY)
    io.invalidate_station(spark, path, "a", _INVALID, DAY)
    io.clear_station(spark, path, "b")
    left = io.read_station(spark, path, "a").unionByName(io.read_station(spark, path, "b"))
    return query.list_stations(left).join(query.station_status(left), "station")


@registered(f"{_ROWS} WHERE ts BETWEEN {T0 + DAY} AND {T0 + 2 * DAY}")
def station_query(spark, sf_dir):
    stations = io.with_blocks(observations(spark, sf_dir), "main", DAY)
    if query.station_query(stations, "elsewhere", T0, T0 + DAY) is not None:
        raise AssertionError("a missing station has no rows")
    return _rows(query.station_query(stations, "main", T0 + DAY, T0 + 2 * DAY, signal="raw", block_secs=DAY))


@registered(f"{_ROWS} WHERE ts // 60 > {T0 + 30 * DAY} // 60 - 20000")
def query_block_cap(spark, sf_dir):
    """A window of more blocks than the cap: the newest are read, with a warning."""
    stations = io.with_blocks(observations(spark, sf_dir), "main", 60)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows, _ = query.query_timeseries(stations, now=T0 + 30 * DAY, lo=T0, limit=10_000, block_secs=60)
        return _rows(query.query_recent(stations, T0, T0 + 30 * DAY, block_secs=60)) if rows is not None else rows


@registered(_DISTINCT)
def merge_hot_cold(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return _rows(io.merge_hot_cold(obs.where(F.col("ts") >= T0 + 10 * DAY), obs.where(F.col("ts") < T0 + 25 * DAY)))


@registered(_ROWS)
def file_sink(spark, sf_dir):
    path, obs = scratch_path(spark, "lines"), observations(spark, sf_dir)
    io.file_sink(obs, path)
    io.null_sink(obs)
    return _rows(spark.read.schema(obs.schema).json(path))


@registered("SELECT event_id, event_type, value FROM events")
def export_csv(spark, sf_dir):
    path, e = scratch_path(spark, "export"), table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    io.export_csv(e, path)
    return spark.read.schema(e.schema).option("header", True).csv(path)


@registered("""SELECT doc_id, length(CASE WHEN text IS NULL THEN to_json({'doc_id': doc_id}) ELSE to_json({'doc_id': doc_id, 'text': text}) END::VARCHAR)
 + length(regexp_replace(coalesce(text, ''), '[\\x{0}-\\x{FFFF}]', '', 'g')) AS units FROM documents""")
def alert_payloads(spark, sf_dir):
    d = io.alert_payloads(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.where(F.col("accepted") == (F.col("units") <= 4096)).select("doc_id", "units")


@registered(f"WITH {CANDLES} SELECT metric_id, t, o, h, l, c, v FROM candles WHERE t BETWEEN 0 AND {T0 + 2 * DAY}")
def station_candles(spark, sf_dir):
    obs = candles.candle_to_observations(_candles(spark, sf_dir), BY)
    return candles.station_candles(obs, -5, T0 + 2 * DAY, BY)


# --- functions --------------------------------------------------------------------------------------------------


@registered("""WITH e AS (SELECT event_id, props->>'k' AS k FROM events) SELECT event_id, TRY_CAST(k AS BIGINT) AS i32, TRY_CAST(k AS DOUBLE) AS f64,
CASE lower(k) WHEN '1' THEN true WHEN '0' THEN false END AS flag, coalesce(k, 'null') AS word, coalesce(TRY_CAST(k AS BIGINT), 0) AS label_int FROM e""")
def cast_value(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    labels = F.create_map(F.lit("k"), k)
    return table(spark, sf_dir, "events").select(
        "event_id", S.cast_value(k, "i32").alias("i32"), S.cast_value(k, "f64").alias("f64"), S.cast_value(F.when(k.isNotNull(), k), "bool").alias("flag"), S.cast_value(k, "string").alias("word"),
        S.label_int(labels, "k").alias("label_int"),
    ).withColumn("flag", F.when(F.col("word") != "null", F.col("flag")))


@registered("SELECT event_id, to_json({'event_id': event_id, 'event_type': event_type})::VARCHAR AS picked FROM events")
def json_select(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "user_id")).alias("j"))
    return e.select("event_id", S.json_select(F.col("j"), ["event_id", "event_type"]).alias("picked"))


@registered("SELECT event_id, to_json({'sum': event_id + user_id, 'none': event_id::VARCHAR})::VARCHAR AS bound FROM events")
def json_bindings(spark, sf_dir):
    b = S.BINDING_FUNCTIONS
    e = table(spark, sf_dir, "events")
    parts = {"sum": b["add"](F.col("event_id"), F.col("user_id")), "ratio": b["div"](F.col("event_id"), F.lit(0)), "none": b["str"](F.col("event_id"))}
    return e.select("event_id", S.json_bindings(parts).alias("bound"))


@registered("SELECT p_partkey, p_name || ' of ' || p_brand || '!' AS filled, 'a' AS first, 2 AS names FROM part")
def render_template(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    out, problem = S.render_template("{{a}} of {{ b }}!", {"a": F.col("p_name"), "b": F.col("p_brand")})
    names = S.placeholder_names(F.lit("{{a}} of {{ b }}! {{a}}"))
    return p.where(problem.isNull()).select("p_partkey", out.alias("filled"), names[0].alias("first"), F.size(names).alias("names"))


@registered("""SELECT doc_id, replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') AS escaped FROM documents""")
def escape_label_value(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.escape_label_value(F.col("text")).alias("escaped"))


@registered(f"""WITH {OBS} SELECT seq, ((seq % 3) * 604800 + (seq % 5) * 3600 + 7) AS duration, ts - (seq % 5 + 1) * 3600 AS ago, ts + (seq % 4 + 1) * 86400 AS ahead, ts AS same,
epoch(date_trunc('day', to_timestamp(ts) AT TIME ZONE 'UTC'))::BIGINT - 86400 AS yesterday, epoch(date_trunc('week', to_timestamp(ts) AT TIME ZONE 'UTC'))::BIGINT - 604800 AS last_week,
epoch(date_trunc('month', to_timestamp(ts) AT TIME ZONE 'UTC') - INTERVAL 1 MONTH)::BIGINT AS last_month FROM obs""")
def time_columns(spark, sf_dir):
    """Durations, relative times and presets in column form, at each event's own now."""
    d, now = observations(spark, sf_dir), F.col("ts")
    text_of = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    duration = text_of((F.col("seq") % 3).cast("string"), "w", (F.col("seq") % 5).cast("string"), "h7s")
    return d.select(
        "seq", S.duration_secs(duration).alias("duration"), S.time_secs(text_of((F.col("seq") % 5 + 1).cast("string"), "h ago"), now).alias("ago"),
        S.time_secs(text_of("now+", (F.col("seq") % 4 + 1).cast("string"), "d"), now).alias("ahead"), S.time_secs(S.ts_to_iso(now), F.lit(0)).alias("same"),
        *[S.range_start(p, now)[0].alias(p) for p in ("yesterday", "last_week", "last_month")],
    )


@registered("SELECT p_partkey, 'type' AS field, p_type AS old, p_type || '!' AS new FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'extra', NULL, 'x' FROM part WHERE p_partkey % 11 = 0")
def config_edits(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    old = p.select("p_partkey", F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type").alias("config"))
    typed = F.when(F.col("p_partkey") % 7 == 0, F.concat("p_type", F.lit("!"))).otherwise(F.col("p_type"))
    plain = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), typed)
    new = p.select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, F.map_concat(plain, F.create_map(F.lit("extra"), F.lit("x")))).otherwise(plain).alias("config"))
    return S.config_edits(old, new, "p_partkey")


# --- ledger helpers ---------------------------------------------------------------------------------------------


def _order_observations(spark, sf_dir) -> DataFrame:
    d = ledger_table(spark, sf_dir)
    names = ("order_id", "status", "dtype", "grid", "level", "size", "pnl_pct")
    labels = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]), lambda _, v: v.isNotNull())
    return d.select(
        "ts", F.lit("orders").alias("metric_id"), F.lit("metric").alias("kind"), F.lit("order").alias("signal"), F.col("entry").alias("value"), labels.alias("labels"), F.lit(None).cast("string").alias("severity"), "seq"
    )


@registered(f"WITH {LEDGER} SELECT order_id, ts, dtype, grid, level, size, round(entry + 1e-9, 4) AS entry, pnl_pct, dtype IN ('long', 'short') AND entry > 0 AS usable FROM led")
def ledger_from_observations(spark, sf_dir):
    good, bad = ledger.ledger_from_observations(_order_observations(spark, sf_dir))
    d = good.withColumn("usable", F.lit(True)).unionByName(bad.withColumn("usable", F.lit(False)))
    return d.withColumn("entry", F.round(F.col("entry") + 1e-9, 4)).select("order_id", "ts", "dtype", "grid", "level", "size", "entry", "pnl_pct", "usable")


_ORDERS = f"""{LEDGER}, w AS (SELECT * FROM led WHERE ts BETWEEN 870000000 - 2592000 AND 870000000),
u AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, seq DESC) = 1), f AS (SELECT * FROM u WHERE status = 'open')"""


@registered(f"WITH {_ORDERS} SELECT order_id, ts, round(entry + 1e-9, 4) AS entry, size FROM f QUALIFY row_number() OVER (ORDER BY ts DESC, seq DESC) <= 200")
def orders(spark, sf_dir):
    found = ledger.orders(_order_observations(spark, sf_dir), now=870_000_000, status="open", limit=200, interval="1d", mark=1500.0)
    d = found["rows"].select(F.col("labels")["order_id"].alias("order_id"), "ts", F.col("value").alias("entry"), F.col("labels")["size"].cast("double").alias("size"))
    return d.withColumn("entry", F.round(F.col("entry") + 1e-9, 4))


@registered(f"WITH {_ORDERS} SELECT (SELECT count(*) FROM w) AS scanned, (SELECT count(*) > 200 FROM f) AS truncated, 'desc' AS \"order\", false AS complete")
def orders_meta(spark, sf_dir):
    return ledger.orders(_order_observations(spark, sf_dir), now=870_000_000, status="open", limit=200)["meta"]


@registered("""WITH p AS (SELECT p_partkey, p_retailprice::DOUBLE AS price FROM part) SELECT p_partkey, round(price + (price * 1.5 - price) * 3 / 4, 6) AS uniform, round(price + 2 * 10.0, 6) AS stepped,
round(price - 5.0, 6) AS centred, 2.0::DOUBLE AS explicit_second, round(2.0 / (1 + 2 + 3 + 4), 9) AS linear_weight, round(exp(-0.25 / 2.25) / (2 * exp(-0.25 / 2.25) + 2 * exp(-1)), 9) AS normal_weight,
round(2 * 0.001 * price, 9) AS least_step, round((0.1 + 2 * 0.001) / 0.3, 9) AS breakeven, 5.0 > 2 * 0.001 * price AS pays, greatest(2, floor((price * 0.5) / (2 * 0.001 * price * 1.5)) + 1)::BIGINT AS most_levels,
round(2 * (greatest(price * 100000 * 0.0005, 10000) + 3300 + price * 100000 * 0.001) / (price * 100000), 9) AS broker FROM p""")
def level_helpers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("price"))
    price = F.col("price")
    d = p.select(
        "p_partkey", F.element_at(ledger.uniform_levels(price, price * 1.5, 5), 4).alias("uniform"), F.element_at(ledger.step_levels(price, price + 35, 10.0), 3).alias("stepped"),
        F.element_at(ledger.centred_levels(price, 5.0, 2), 2).alias("centred"), F.element_at(ledger.explicit_levels([3.0, 1.0, 2.0, 2.0]), 2).alias("explicit_second"),
        F.element_at(ledger.weights(4, "linear"), 2).alias("linear_weight"), F.element_at(ledger.weights(4, "normal"), 2).alias("normal_weight"),
        ledger.min_profitable_step(price, 0.001).alias("least_step"), ledger.breakeven_win_p(F.lit(0.1), F.lit(0.2), 0.001).alias("breakeven"), ledger.is_step_profitable(F.lit(5.0), price, 0.001).alias("pays"),
        ledger.max_levels_for_profit(price, price * 1.5, 0.001).alias("most_levels"), ledger.broker_fee(price, "vps_standard").alias("broker"),
    )
    return rounded(rounded(d, "uniform", "stepped", "centred"), "linear_weight", "normal_weight", "least_step", "breakeven", "broker", digits=9)


# --- statistics, exposition, machine learning -------------------------------------------------------------------


@registered("SELECT l_returnflag, round(quantile_cont(l_quantity::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(l_quantity::DOUBLE, 0.999), 6) AS p99_9, round(avg(l_quantity), 6) AS mean, count(*) AS count FROM lineitem GROUP BY 1")
def deployment_comparison(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("value"))
    return rounded(capacity.deployment_comparison(d, "l_returnflag"), "p50", "p99_9", "mean").select("l_returnflag", "p50", "p99_9", "mean", "count")


@registered(f"WITH {OBS} SELECT metric_id, round(avg((value > 100)::INT), 6) AS probability, count(*) FILTER (value > 100) AS above, count(*) AS n FROM obs GROUP BY 1")
def exceedance(spark, sf_dir):
    return rounded(probability.exceedance(observations(spark, sf_dir), BY, 100.0), "probability")


@registered(f"""WITH {OBS} SELECT metric_id, (ts // 3600) % 24 AS hour, ts // {DAY} AS day, round(avg(value), 6) AS value, count(*) AS n FROM obs GROUP BY 1, 2, 3""")
def heat_data(spark, sf_dir):
    d = observations(spark, sf_dir).withColumn("hour", F.floor(F.col("ts") / 3600) % 24).withColumn("day", F.floor(F.col("ts") / DAY))
    return rounded(stats.heat_data(d, BY, "hour", "day"), "value")


@registered(f"""WITH {OBS}, s AS (SELECT metric_id, ts, seq, list(value) OVER (PARTITION BY metric_id ORDER BY ts, seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS w FROM obs)
SELECT metric_id, ts, seq, round(w[1] + 10 * w[2] + 100 * w[3] + 1000 * w[4], 4) AS mixed FROM s WHERE len(w) = 4""")
def shingle(spark, sf_dir):
    d = anomaly.shingle(observations(spark, sf_dir), BY, 4).where("shingle IS NOT NULL")
    w = F.col("shingle")
    return rounded(d.select("metric_id", "ts", "seq", (w[0] + 10 * w[1] + 100 * w[2] + 1000 * w[3]).alias("mixed")), "mixed", digits=4)


@registered()
def rcf_transient(spark, sf_dir):
    """The last day of each metric against forests of the days before it."""
    obs = observations(spark, sf_dir)
    recent = timeseries.recent_window(obs, BY, DAY)
    past = timeseries.before_window(obs, BY, DAY)
    return rounded(anomaly.rcf_score_transient(past, recent, BY), "score")


@registered("""SELECT s_name AS node, 'running' AS metric, (s_acctbal > 0)::INT::DOUBLE AS value FROM supplier UNION ALL SELECT s_name, 'faults', s_nationkey::DOUBLE FROM supplier UNION ALL SELECT s_name, 'info', 1.0 FROM supplier""")
def node_metrics(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return exposition.node_metrics(s.select(F.col("s_name").alias("node"), (F.col("s_acctbal") > 0).cast("int").alias("running"), F.col("s_nationkey").alias("faults"), F.lit("x").alias("kind")))


@registered("""WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - a) / (b - a), 6) AS x, round((l_extendedprice - c) / (d - c), 6) AS y FROM lineitem, e""")
def scaled_features(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    d = ml.scaled(ml.prepare(li, None, ["q", "p"])[0], "minmax").withColumn("v", vector_to_array("scaled"))
    return rounded(d.select("l_orderkey", "l_linenumber", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")), "x", "y")


@registered("SELECT DISTINCT p_brand AS pattern FROM part UNION SELECT DISTINCT p_type FROM part")
def pattern_persist(spark, sf_dir):
    path, p = scratch_path(spark, "patterns"), table(spark, sf_dir, "part")
    known = text.pattern_add(p.select(F.col("p_brand").alias("pattern")), p.select(F.col("p_type").alias("pattern")))
    text.pattern_persist(known, path)
    return text.read_patterns(spark, path)


# --- streams and user-defined functions -------------------------------------------------------------------------


def _stream_observations(spark, sf_dir) -> DataFrame:
    return _event_stream(spark, sf_dir).withColumns({"kind": F.lit("metric"), "signal": F.lit("raw"), "labels": F.create_map().cast("map<string,string>"), "severity": F.lit(None).cast("string")})


@registered("SELECT event_type || '_mean' AS metric_id, round(avg(value), 6) AS value FROM events GROUP BY 1")
def stream_transform(spark, sf_dir):
    """A registered transform of each micro-batch, through a sink that a repeated batch overwrites."""
    path = scratch_path(spark, "transformed")
    jobs.transformed(_stream_observations(spark, sf_dir), "batch_mean", sink=jobs.idempotent_writer(path), checkpoint=scratch_path(spark, "transformed-checkpoint"))
    return rounded(spark.read.parquet(path), "value").select("metric_id", "value")


@registered(f"WITH {OBS} SELECT metric_id, max(ts) AS last_ts, count(*) AS n FROM obs GROUP BY 1")
def stream_cursor(spark, sf_dir):
    path = scratch_path(spark, "cursor")
    d = jobs.cursor(_event_stream(spark, sf_dir), BY)
    d.writeStream.foreachBatch(jobs.idempotent_writer(path)).option("checkpointLocation", scratch_path(spark, "cursor-checkpoint")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("metric_id").agg(F.max("last_ts").alias("last_ts"), F.max("n").alias("n"))


@registered("SELECT 'sink' AS node, 'ValueError' AS code, 'error' AS severity, count(DISTINCT 1) AS count FROM events")
def stream_faults(spark, sf_dir):
    """A sink that fails leaves a fault; the stream goes on."""
    faults = scratch_path(spark, "faults")

    def work(batch: DataFrame, batch_id: int) -> None:
        raise ValueError(f"{batch.count()} rows refused")

    q = _event_stream(spark, sf_dir).writeStream.foreachBatch(jobs.tolerant(work, faults, "sink"))
    q.option("checkpointLocation", scratch_path(spark, "faults-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return jobs.current_faults(spark.read.parquet(faults)).select("node", "code", "severity", "count")


@registered("SELECT src, count(*) AS n FROM events, (VALUES ('first'), ('second')) s(src) GROUP BY 1")
def stream_tap(spark, sf_dir):
    """One stream routed by its source and handed to two sinks."""
    first, second = scratch_path(spark, "first"), scratch_path(spark, "second")
    e = _event_stream(spark, sf_dir)
    routed = jobs.route({"events": e, "other": e.where("value < 0")}, "events")
    q = routed.writeStream.foreachBatch(jobs.tap(jobs.idempotent_writer(first), jobs.idempotent_writer(second)))
    q.option("checkpointLocation", scratch_path(spark, "tap-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    both = spark.read.parquet(first).withColumn("src", F.lit("first")).unionByName(spark.read.parquet(second).withColumn("src", F.lit("second")))
    return both.groupBy("src").agg(F.count("*").alias("n"))


_ARRIVAL = "(seq * 7919) % 100003"


@registered(f"""WITH {OBS}, a AS (SELECT *, max(ts) OVER (PARTITION BY metric_id ORDER BY {_ARRIVAL}, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM obs)
SELECT metric_id, count(*) AS late FROM a WHERE (ts // 3600 + 1) * 3600 <= seen GROUP BY 1""")
def late_rows(spark, sf_dir):
    """Rows that come after their hour was closed, in a made-up order of arrival."""
    d = observations(spark, sf_dir).withColumn("seq", F.expr(f"{_ARRIVAL} * 1000000000 + seq"))
    return jobs.late_rows(d, BY, 3600)


@registered(f"WITH {OBS} SELECT metric_id, max(ts) AS last_ts FROM obs GROUP BY 1 HAVING {T0 + 30 * DAY} - max(ts) > 600")
def staleness(spark, sf_dir):
    return jobs.staleness(observations(spark, sf_dir), BY, T0 + 30 * DAY, 600)


@registered(f"WITH {OBS} SELECT metric_id, count(*) AS n, round(max(value) - min(value), 6) AS width FROM obs GROUP BY 1")
def keyed_function(spark, sf_dir):
    """A user's pandas function of each key's hour, and sums of its rows."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"metric_id": [pdf["metric_id"].iloc[0]], "n": [len(pdf)], "lo": [pdf["value"].min()], "hi": [pdf["value"].max()]})

    d = observations(spark, sf_dir).select("metric_id", F.floor(F.col("ts") / 3600).alias("hour"), "value")
    g = registry.keyed(d, ["metric_id", "hour"], run, "metric_id string, n bigint, lo double, hi double")
    return rounded(g.groupBy("metric_id").agg(F.sum("n").alias("n"), (F.max("hi") - F.min("lo")).alias("width")), "width")


@registered(f"WITH {CANDLES} SELECT metric_id, round(avg(c), 6) AS level, count(*) AS bars FROM candles GROUP BY 1")
def plan_function(spark, sf_dir):
    """A user's function from a key's candles and its earlier plans to new plans."""
    c = _candles(spark, sf_dir)
    previous = c.groupBy("metric_id").agg(F.min("c").alias("level"))

    def plan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"metric_id": [b["metric_id"].iloc[0]], "level": [a["c"].mean()], "bars": [len(a)]})

    return rounded(registry.plan_function(c, previous, BY, plan, "metric_id string, level double, bars bigint", min_candles=2), "level")


@registered(f"WITH {OBS} SELECT seq, (ts // 900) * 900 AS bucket, round(greatest(0, (0.6 / 0.5 - 0.4) * 0.5), 6) AS stake FROM obs")
def sql_functions(spark, sf_dir):
    registry.register_functions(spark)
    return observations(spark, sf_dir).selectExpr("seq", "bucket_align(ts, 900L) AS bucket", "round(kelly(0.6D, 0.5D), 6) AS stake")
