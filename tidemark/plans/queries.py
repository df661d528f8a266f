"""Registered queries of the time-series operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import anomaly, candles, capacity, exposition, forecast, indicators, ledger, ml, probability, query, stats, text, timeseries, trend
from tidemark.operators import grid as G
from tidemark.operators.sliced import with_index
from tidemark.plans import registry
from tidemark.schema import ledger as ledger_table
from tidemark.schema import observations, table
from tidemark.streaming import jobs

BY = ["metric_id"]
T0 = 1_704_067_200  # 2024-01-01 UTC
DAY = 86_400

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

OBS = """obs AS (
  SELECT floor(epoch_us(ts) / 1000000)::BIGINT AS ts, event_type AS metric_id, value::DOUBLE AS value, event_id AS seq,
         user_id::VARCHAR AS user_id, props->>'k' AS k
  FROM events)"""
CANDLES = f"""{OBS},
candles AS (
  SELECT metric_id, (ts // 3600) * 3600 AS t, arg_min(value, (ts, seq)) AS o, max(value) AS h, min(value) AS l,
         arg_max(value, (ts, seq)) AS c, count(*)::DOUBLE AS v
  FROM obs WHERE value > 0 GROUP BY 1, 2)"""
LEDGER = """led AS (
  SELECT epoch(l_shipdate)::BIGINT AS ts, l_orderkey || '-' || l_linenumber AS order_id,
         CASE WHEN l_linestatus = 'F' THEN 'closed' ELSE 'open' END AS status,
         CASE l_returnflag WHEN 'A' THEN 'long' WHEN 'R' THEN 'short' ELSE 'unknown' END AS dtype,
         (l_suppkey % 4)::INT AS grid, l_linenumber AS level, l_quantity::DOUBLE AS size, l_extendedprice / l_quantity AS entry,
         CASE WHEN l_linestatus = 'F' THEN (l_discount - l_tax)::DOUBLE END AS pnl_pct,
         l_partkey * 1000000 + l_suppkey * 100 + l_quantity::BIGINT AS seq
  FROM lineitem)"""


def registered(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Rounds as the SQL does: a double, times 10 ** digits, to the nearest whole number; ``F.round`` looks at its decimal digits, so ties differ."""
    kinds, scale = dict(df.dtypes), F.lit(10.0**digits)

    def to(n: str) -> Column:
        scaled = F.col(n) * scale
        near = F.when(F.abs(scaled) < float("inf"), F.round(scaled) / scale).otherwise(F.col(n))
        return near if kinds.get(n) == "double" else F.round(n, digits)

    return df.withColumns({n: to(n) for n in names})


def _candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.tick_to_candle(observations(spark, sf_dir), BY, 3600)


# --- flagship and range queries ---------------------------------------------------------------------------------


@registered(f"""WITH {OBS},
r AS (SELECT metric_id, ts, value FROM obs WHERE ts BETWEEN {T0} AND {T0 + 10 * DAY}),
a AS (SELECT metric_id, min(ts) AS t0 FROM r GROUP BY 1),
b AS (SELECT r.metric_id, t0 + ((r.ts - t0) // 3600) * 3600 AS bucket, avg(value) AS value FROM r JOIN a USING (metric_id) GROUP BY 1, 2)
SELECT metric_id, count(*) AS count, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean,
       round(coalesce(var_samp(value), 0), 6) AS variance, max(bucket) AS ts FROM b GROUP BY 1""")
def flagship_hourly_summary(spark, sf_dir):
    """Range filter, hourly means from the first point, summary of them."""
    recent = query.query_recent(observations(spark, sf_dir), T0, T0 + 10 * DAY)
    hourly = timeseries.resample(recent, BY, 3600).withColumnRenamed("bucket", "ts")
    return rounded(timeseries.summary_stats(hourly, BY), "min", "max", "mean", "variance")


@registered(f"WITH {OBS} SELECT metric_id, ts, value, seq FROM obs WHERE ts BETWEEN {T0} AND {T0 + DAY}")
def query_recent(spark, sf_dir):
    return query.query_recent(observations(spark, sf_dir), T0, T0 + DAY).select("metric_id", "ts", "value", "seq")


@registered(f"""WITH {OBS} SELECT metric_id, ts, value, seq FROM obs WHERE ts BETWEEN {T0} AND {T0 + 20 * DAY}
ORDER BY ts DESC, seq DESC LIMIT 100""")
def query_timeseries(spark, sf_dir):
    rows, _ = query.query_timeseries(observations(spark, sf_dir), now=T0 + 20 * DAY, lo=T0, limit=100, signal="raw")
    return rows.select("metric_id", "ts", "value", "seq")


@registered(f"""WITH {OBS} SELECT count(*) AS scanned, count(*) > 100 AS truncated, 'desc' AS "order", true AS complete FROM obs WHERE ts BETWEEN {T0} AND {T0 + 20 * DAY}""")
def query_timeseries_meta(spark, sf_dir):
    return query.query_timeseries(observations(spark, sf_dir), now=T0 + 20 * DAY, lo=T0, limit=100, signal="raw")[1]


@registered(f"""WITH {OBS},
c AS (SELECT DISTINCT ts // {DAY} AS blk FROM obs WHERE ts // {DAY} BETWEEN {T0 // DAY} AND {T0 // DAY + 2})
SELECT metric_id, ts, value, seq FROM obs WHERE ts BETWEEN {T0} AND {T0 + 2 * DAY} AND (SELECT count(*) FROM c) = 3""")
def query_range_all_or_nothing(spark, sf_dir):
    obs = observations(spark, sf_dir)
    cover = query.block_coverage(obs, [], DAY)
    return query.query_range(obs, cover, T0, T0 + 2 * DAY, DAY).select("metric_id", "ts", "value", "seq")


@registered(f"WITH {OBS} SELECT metric_id, ts // {DAY} AS blk, min(ts) AS from_ts, max(ts) AS to_ts, count(*) AS rows FROM obs GROUP BY 1, 2")
def block_coverage(spark, sf_dir):
    return query.block_coverage(observations(spark, sf_dir), BY, DAY)


@registered(f"WITH {OBS} SELECT metric_id, ts, value, seq FROM obs WHERE ts > {T0} AND ts <= {T0 + DAY} AND metric_id = 'view'")
def query_lake_edges(spark, sf_dir):
    return query.query_lake(observations(spark, sf_dir), T0, T0 + DAY, "view").select("metric_id", "ts", "value", "seq")


@registered(f"WITH {OBS} SELECT metric_id, arg_max(value, (ts, seq)) AS value, max(ts) AS ts FROM obs GROUP BY 1")
def latest(spark, sf_dir):
    return query.latest(observations(spark, sf_dir), BY)


@registered(f"WITH {OBS} SELECT metric_id, arg_min(value, (ts, seq)) AS first, arg_max(value, (ts, seq)) AS last FROM obs GROUP BY 1")
def first_last(spark, sf_dir):
    return query.first_last(observations(spark, sf_dir), BY)


@registered(f"""WITH {OBS} SELECT metric_id, ts, value, seq FROM obs
QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY ts DESC, seq DESC) <= 5""")
def latest_n(spark, sf_dir):
    return query.latest_n(observations(spark, sf_dir), BY, 5).select("metric_id", "ts", "value", "seq")


@registered("SELECT DISTINCT event_type AS metric_id FROM events")
def list_metrics(spark, sf_dir):
    return query.list_metrics(observations(spark, sf_dir))


@registered(f"""WITH {OBS} SELECT metric_id, count(*) AS records, count(DISTINCT ts // {DAY}) AS blocks, min(ts) AS min_ts, max(ts) AS max_ts,
'metric' AS kinds, 1::BIGINT AS metrics FROM obs GROUP BY 1""")
def describe_station(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return query.describe_station(obs.withColumn("m", F.col("metric_id")).drop("metric_id").withColumn("metric_id", F.col("m")), ["m"], DAY).withColumnRenamed("m", "metric_id")


@registered(f"WITH {OBS} SELECT metric_id, ts, value, seq FROM obs WHERE ts < {T0 + 5 * DAY}")
def invalidate_from(spark, sf_dir):
    return query.invalidate_from(observations(spark, sf_dir), T0 + 5 * DAY).select("metric_id", "ts", "value", "seq")


# --- time series ------------------------------------------------------------------------------------------------


@registered(f"""WITH {OBS} SELECT metric_id, round((arg_max(value, (ts, seq)) - arg_min(value, (ts, seq))) / (max(ts) - min(ts)), 12) AS rate FROM obs GROUP BY 1""")
def ts_rate(spark, sf_dir):
    return rounded(timeseries.rate(observations(spark, sf_dir), BY), "rate", digits=12)


@registered(f"""WITH {OBS} SELECT o.metric_id, o.ts, o.seq, round(avg(p.value), 6) AS moving_avg FROM obs o JOIN obs p
ON p.metric_id = o.metric_id AND p.ts BETWEEN o.ts - 7200 AND o.ts AND (p.ts < o.ts OR p.seq <= o.seq) GROUP BY 1, 2, 3""")
def ts_moving_avg(spark, sf_dir):
    d = timeseries.moving_avg(observations(spark, sf_dir), BY, 7200)
    return rounded(d, "moving_avg").select("metric_id", "ts", "seq", "moving_avg")


@registered(f"""WITH {OBS}, a AS (SELECT metric_id, min(ts) AS t0 FROM obs GROUP BY 1)
SELECT obs.metric_id, t0 + ((ts - t0) // 7200) * 7200 AS bucket, round(sum(value), 6) AS value FROM obs JOIN a USING (metric_id) GROUP BY 1, 2""")
def ts_resample(spark, sf_dir):
    return rounded(timeseries.resample(observations(spark, sf_dir), BY, 7200, "sum"), "value")


@registered(f"WITH {OBS} SELECT metric_id, round(quantile_cont(value, 0.5), 6) AS quantile FROM obs GROUP BY 1")
def ts_median(spark, sf_dir):
    return rounded(timeseries.quantile(observations(spark, sf_dir), BY, 0.5), "quantile")


_FLOOR_RANK = """WITH {obs}, r AS (SELECT metric_id, value, row_number() OVER (PARTITION BY metric_id ORDER BY value) AS rn,
count(*) OVER (PARTITION BY metric_id) AS n FROM obs) SELECT metric_id, value AS quantile FROM r WHERE rn = floor({q} * (n - 1)) + 1"""


@registered(_FLOOR_RANK.format(obs=OBS, q=0.95))
def ts_p95(spark, sf_dir):
    return timeseries.p95(observations(spark, sf_dir), BY)


@registered(_FLOOR_RANK.format(obs=OBS, q=0.99))
def ts_p99(spark, sf_dir):
    return timeseries.p99(observations(spark, sf_dir), BY)


_LAG = f"WITH {OBS}, d AS (SELECT *, lag(value) OVER (PARTITION BY metric_id ORDER BY ts, seq) AS p, lag(ts) OVER (PARTITION BY metric_id ORDER BY ts, seq) AS pt FROM obs)"


@registered(f"{_LAG} SELECT metric_id, ts, seq, round(value - p, 6) AS delta FROM d WHERE p IS NOT NULL")
def ts_delta(spark, sf_dir):
    return rounded(timeseries.delta(observations(spark, sf_dir), BY), "delta").select("metric_id", "ts", "seq", "delta")


@registered(f"{_LAG} SELECT metric_id, ts, seq, round((value - p) / abs(p), 6) AS pct_change FROM d WHERE p IS NOT NULL")
def ts_pct_change(spark, sf_dir):
    return rounded(timeseries.pct_change(observations(spark, sf_dir), BY, flat=False), "pct_change").select("metric_id", "ts", "seq", "pct_change")


@registered(f"""WITH {OBS} SELECT metric_id, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
round(coalesce(var_samp(value), 0), 6) AS variance, max(ts) AS ts FROM obs GROUP BY 1""")
def summary_stats(spark, sf_dir):
    return rounded(timeseries.summary_stats(observations(spark, sf_dir), BY), "mean", "variance")


@registered(f"WITH {OBS} SELECT seq, metric_id || '_mean' AS mean_metric, round(avg(value) OVER (PARTITION BY metric_id), 6) AS batch_mean FROM obs")
def batch_mean(spark, sf_dir):
    return rounded(timeseries.batch_mean(observations(spark, sf_dir), BY), "batch_mean").select("seq", "mean_metric", "batch_mean")


@registered(f"""WITH {OBS}, b AS (SELECT *, avg(value) OVER (PARTITION BY metric_id) AS m FROM obs) SELECT metric_id, count(*) AS n,
CASE WHEN value >= 200 THEN 'saturated' WHEN value - m > 50 THEN 'spike' ELSE 'ok' END AS label FROM b GROUP BY 1, 3""")
def spike_check(spark, sf_dir):
    d = timeseries.spike_check(observations(spark, sf_dir), BY, saturated=200.0, spike_delta=50.0)
    return d.groupBy("metric_id", "label").agg(F.count("*").alias("n"))


@registered(f"WITH {OBS}, m AS (SELECT metric_id, max(ts) AS t FROM obs GROUP BY 1) SELECT metric_id, ts, seq, value FROM obs JOIN m USING (metric_id) WHERE ts > t - {DAY}")
def recent_window(spark, sf_dir):
    return timeseries.recent_window(observations(spark, sf_dir), BY, DAY).select("metric_id", "ts", "seq", "value")


@registered(f"WITH {OBS} SELECT metric_id, coalesce(user_id, '?') AS label, arg_max(value, (ts, -seq)) AS value, max(ts) AS ts FROM obs GROUP BY 1, 2")
def latest_per_label(spark, sf_dir):
    return timeseries.latest_per_label(observations(spark, sf_dir), BY, "user_id")


@registered(f"WITH {OBS} SELECT metric_id, ((max(ts) - min(ts)) // (count(*) - 1))::BIGINT AS interval FROM obs GROUP BY 1")
def sampling_interval(spark, sf_dir):
    return timeseries.sampling_interval(observations(spark, sf_dir), BY)


@registered(f"{_LAG}, g AS (SELECT metric_id, ts - pt AS gap, row_number() OVER (PARTITION BY metric_id ORDER BY ts - pt) AS rn, count(*) OVER (PARTITION BY metric_id) AS n FROM d WHERE pt IS NOT NULL) SELECT metric_id, gap::BIGINT AS median_gap FROM g WHERE rn = n // 2 + 1")
def median_gap(spark, sf_dir):
    return timeseries.median_gap(observations(spark, sf_dir), BY)


@registered(f"""WITH {OBS}, b AS (SELECT metric_id, (ts // 900) * 900 AS bucket, count(*)::DOUBLE AS value FROM obs GROUP BY 1, 2),
e AS (SELECT metric_id, unnest(range(min(bucket), max(bucket) + 1, 900)) AS bucket FROM b GROUP BY 1)
SELECT e.metric_id, e.bucket::BIGINT AS bucket, coalesce(value, 0) AS value FROM e LEFT JOIN b USING (metric_id, bucket)""")
def gap_fill_buckets(spark, sf_dir):
    d = timeseries.resample(observations(spark, sf_dir), BY, 900, "count", anchor="epoch")
    return timeseries.gap_fill(d, BY, "bucket", 900, ["value"])


@registered(f"WITH {OBS}, u AS (SELECT * FROM obs UNION ALL SELECT * FROM obs) SELECT count(*) AS rows FROM (SELECT DISTINCT ts, metric_id, value, user_id, k FROM u)")
def dedup_exact(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return timeseries.dedup_exact(obs.unionByName(obs)).agg(F.count("*").alias("rows"))


# --- candles ----------------------------------------------------------------------------------------------------


@registered(f"WITH {CANDLES} SELECT * FROM candles")
def tick_to_candle(spark, sf_dir):
    return _candles(spark, sf_dir)


@registered(f"""WITH {CANDLES} SELECT metric_id, t, o, h, l, c, v FROM candles""")
def candles_round_trip(spark, sf_dir):
    """Candles to observations and back."""
    obs = candles.candle_to_observations(_candles(spark, sf_dir), BY)
    return candles.candles_from_observations(obs, BY)


@registered(f"WITH {CANDLES} SELECT metric_id, t, coalesce(nullif(o, 0), c) AS o, c, greatest(o, c) AS h, least(o, c) AS l, v FROM candles")
def reconcile_candle(spark, sf_dir):
    d = _candles(spark, sf_dir).withColumn("h", F.lit(None).cast("double")).withColumn("l", F.lit(0.0))
    return candles.reconcile(d)


@registered(f"""WITH {CANDLES}, x AS (SELECT * FROM candles WHERE t < {T0 + 9 * DAY}), y AS (SELECT * FROM candles WHERE t >= {T0 + 8 * DAY})
SELECT * FROM x WHERE t + 3600 <= {T0 + 20 * DAY} UNION ALL SELECT * FROM y ANTI JOIN (SELECT * FROM x WHERE t + 3600 <= {T0 + 20 * DAY}) z USING (metric_id, t)""")
def merge_candles(spark, sf_dir):
    c = _candles(spark, sf_dir)
    return candles.merge_candles(c.where(F.col("t") < T0 + 9 * DAY), c.where(F.col("t") >= T0 + 8 * DAY), BY, T0 + 20 * DAY, 3600)


@registered(f"WITH {CANDLES} SELECT metric_id, t, o, h, l, c, v FROM candles WHERE t + 3600 <= {T0 + 10 * DAY + 60} QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY t DESC) = 1")
def last_closed(spark, sf_dir):
    return candles.last_closed(_candles(spark, sf_dir), BY, T0 + 10 * DAY + 60, 3600)


@registered(f"WITH {CANDLES} SELECT metric_id, t, greatest(o, c) AS body_high, least(o, c) AS body_low FROM candles")
def candle_body(spark, sf_dir):
    return candles.body(_candles(spark, sf_dir)).select("metric_id", "t", "body_high", "body_low")


@registered(f"""WITH {CANDLES} SELECT metric_id, t, (CASE WHEN isodow(make_timestamp((t + 3600) * 1000000)) >= 6
THEN ((t + 3600) // 86400 + 8 - isodow(make_timestamp((t + 3600) * 1000000))) * 86400 ELSE t + 3600 END)::BIGINT AS next FROM candles""")
def calendar_next(spark, sf_dir):
    return _candles(spark, sf_dir).select("metric_id", "t", candles.calendar_next(F.col("t"), "forex", 3600).alias("next"))


@registered(f"""WITH {CANDLES}, e AS (SELECT metric_id, unnest(range(min(t), max(t) + 1, 3600)) AS t FROM candles GROUP BY 1)
SELECT e.metric_id, e.t::BIGINT AS t, candles.t IS NOT NULL AS present FROM e LEFT JOIN candles ON candles.metric_id = e.metric_id AND candles.t = e.t""")
def trading_sessions(spark, sf_dir):
    return candles.trading_sessions(_candles(spark, sf_dir), BY, "crypto", 3600)


@registered(f"""WITH {CANDLES} SELECT metric_id, t, round(list_sum(list(c) OVER w) + (5 - len(list(c) OVER w)) * (list(c) OVER w)[1], 6) AS closes_sum
FROM candles WINDOW w AS (PARTITION BY metric_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def ohlcv_window(spark, sf_dir):
    d = candles.ohlcv_window(_candles(spark, sf_dir), BY, 5)
    return d.select("metric_id", "t", F.round(F.aggregate("closes", F.lit(0.0), lambda a, x: a + x), 6).alias("closes_sum"))


# --- grids, transitions, trend ----------------------------------------------------------------------------------

_BITS = 8


def _fold_sql(bits: int) -> str:
    """The level fold as nested steps, one CTE column set per level; growth is a segment's (pair of consecutive points)."""
    parts, prev = [], "s"
    parts.append("s AS (SELECT *, 0 AS lv, 0.0::DOUBLE AS gr, false AS st, 0.0::DOUBLE AS la FROM x)")
    for i in range(bits + 1):
        growth = f"((x{i} - la) / seg)"
        sharp = f"(({i} >= 2) AND {growth} > gr * 1.3 AND {growth} >= 0.02 AND gr > 0)"
        parts.append(
            f"s{i} AS (SELECT * REPLACE (CASE WHEN st OR {sharp} THEN lv ELSE {i} END AS lv, CASE WHEN st OR {sharp} THEN gr ELSE {growth} END AS gr, "
            f"(st OR {sharp}) AS st, CASE WHEN st OR {sharp} THEN la ELSE x{i} END AS la) FROM {prev})"
        )
        prev = f"s{i}"
    return ",\n".join(parts) + f",\ngrids AS (SELECT metric_id, (gmax - gmin) / pow(2, lv) AS step, gmin, gmax, lv FROM {prev})"


def _grids(bits: int, lo: str, hi: str, secs: str) -> str:
    """CTEs of a fitted grid, its occupancy, dominant cells (empty intervals: the top cell) and moves; ``secs``: an interval, from t0 and t1."""
    levels = ", ".join(f"coalesce(sum(abs((cell >> {bits - i}) - (before >> {bits - i}))), 0)::DOUBLE AS x{i}" for i in range(bits + 1))
    return f"""ends AS (SELECT metric_id, {lo} AS gmin, {hi} AS gmax FROM obs GROUP BY 1),
cells AS (SELECT obs.*, gmin, gmax, greatest(0, least({(1 << bits) - 1}, floor((value - gmin) / (gmax - gmin) * {1 << bits})))::BIGINT AS cell FROM obs JOIN ends USING (metric_id)),
lagged AS (SELECT *, lag(cell) OVER (PARTITION BY metric_id ORDER BY ts, seq) AS before FROM cells),
x AS (SELECT metric_id, min(gmin) AS gmin, max(gmax) AS gmax, greatest(count(*) - 1, 1) AS seg, {levels} FROM lagged GROUP BY 1),
{_fold_sql(bits)},
placed AS (SELECT obs.*, step, gmin, gmax, greatest(1, ceil((gmax - gmin) / step))::BIGINT AS nc,
  (CASE WHEN value <= gmin THEN 0 WHEN value >= gmax THEN greatest(1, ceil((gmax - gmin) / step)) - 1 ELSE floor((value - gmin) / step) END)::BIGINT AS cell
  FROM obs JOIN grids USING (metric_id)),
t0s AS (SELECT metric_id, min(ts) AS t0, max(ts) AS t1 FROM obs GROUP BY 1),
occ AS (SELECT metric_id, ((ts - t0) // ({secs}))::BIGINT AS bucket, cell, count(*) AS n FROM placed JOIN t0s USING (metric_id) GROUP BY 1, 2, 3),
dom0 AS (SELECT metric_id, bucket, arg_max(cell, (n, cell)) AS cell FROM occ GROUP BY 1, 2),
spine AS (SELECT metric_id, unnest(range(max(bucket) + 1)) AS bucket FROM dom0 GROUP BY 1),
dom AS (SELECT spine.metric_id, spine.bucket, coalesce(dom0.cell, greatest(1, ceil((gmax - gmin) / step))::BIGINT - 1) AS cell
  FROM spine LEFT JOIN dom0 USING (metric_id, bucket) JOIN grids USING (metric_id)),
moves AS (SELECT metric_id, cell AS "from", lead(cell) OVER (PARTITION BY metric_id ORDER BY bucket) AS "to" FROM dom)"""


GRIDS = f"{OBS},\n" + _grids(_BITS, "min(value)", "max(value)", str(DAY))


def _grid(spark, sf_dir):
    return G.fit_values(observations(spark, sf_dir), BY, max_bit=_BITS)


def _dominant(spark, sf_dir):
    return G.dominant_cells(observations(spark, sf_dir), BY, _grid(spark, sf_dir), DAY)


@registered(f"WITH {GRIDS} SELECT metric_id, round(step, 6) AS step, gmin, gmax, lv::INT AS level, {_BITS} AS max_bit FROM grids")
def grid_fit(spark, sf_dir):
    return rounded(_grid(spark, sf_dir), "step").select("metric_id", "step", "gmin", "gmax", "level", "max_bit")


@registered(f"WITH {GRIDS}, p AS (SELECT *, lag(cell) OVER (PARTITION BY metric_id ORDER BY ts, seq) AS b FROM placed) SELECT metric_id, sum(abs(cell - b))::BIGINT AS crossings FROM p GROUP BY 1")
def grid_crossings(spark, sf_dir):
    return G.crossings(observations(spark, sf_dir), BY, _grid(spark, sf_dir))


@registered(f"WITH {GRIDS} SELECT metric_id, bucket, cell, n FROM occ")
def grid_occupancy(spark, sf_dir):
    return G.occupancy(observations(spark, sf_dir), BY, _grid(spark, sf_dir), DAY)


@registered(f"WITH {GRIDS} SELECT metric_id, i::BIGINT AS cell, round(gmin + i * step, 6) AS low, round(gmin + i * step + step, 6) AS high FROM (SELECT *, unnest(range(greatest(1, ceil((gmax - gmin) / step))::BIGINT)) AS i FROM grids)")
def grid_ranges(spark, sf_dir):
    return rounded(G.ranges(_grid(spark, sf_dir), BY), "low", "high")


@registered(f'WITH {GRIDS} SELECT metric_id, "from", "to", count(*) AS n FROM moves WHERE "to" IS NOT NULL GROUP BY ALL')
def grid_transitions(spark, sf_dir):
    return G.transitions(_dominant(spark, sf_dir), BY)


_PROBS = 'round(avg(("to" > "from")::INT), 6) AS up, round(avg(("to" < "from")::INT), 6) AS down, round(avg(("to" = "from")::INT), 6) AS stay, count(*) AS moves FROM moves WHERE "to" IS NOT NULL'


@registered(f"WITH {GRIDS} SELECT metric_id, {_PROBS} GROUP BY 1")
def move_probabilities(spark, sf_dir):
    return rounded(G.move_probabilities(G.transitions(_dominant(spark, sf_dir), BY), BY), "up", "down", "stay")


@registered(f'WITH {GRIDS} SELECT metric_id, "from", {_PROBS} GROUP BY 1, 2')
def move_probabilities_per_cell(spark, sf_dir):
    return rounded(G.move_probabilities(G.transitions(_dominant(spark, sf_dir), BY), BY, per_cell=True), "up", "down", "stay")


@registered(f"""WITH {GRIDS}, r AS (SELECT *, bucket - row_number() OVER (PARTITION BY metric_id, cell ORDER BY bucket) AS g FROM dom),
runs AS (SELECT metric_id, cell, g, count(*) AS dwell FROM r GROUP BY 1, 2, 3)
SELECT metric_id, cell, round(avg(dwell), 6) AS mean_dwell, max(dwell) AS max_dwell FROM runs GROUP BY 1, 2""")
def dwell_times(spark, sf_dir):
    return rounded(G.dwell_summary(_dominant(spark, sf_dir), BY), "mean_dwell")


@registered(f"{_LAG} SELECT metric_id, round(abs(sum(value - p)) / sum(abs(value - p)), 6) AS efficiency, round(sum(value - p) / sum(abs(value - p)), 6) AS slope_ratio FROM d GROUP BY 1")
def efficiency_ratio(spark, sf_dir):
    return rounded(G.efficiency_ratio(observations(spark, sf_dir), BY), "efficiency", "slope_ratio")


_CHAIN = """tr AS (SELECT metric_id, "from", "to", count(*)::DOUBLE AS n FROM moves WHERE "to" IS NOT NULL GROUP BY ALL),
pr AS (SELECT metric_id, "from", "to", n / sum(n) OVER (PARTITION BY metric_id, "from") AS p FROM tr)"""


def _steps(p: str, n: int) -> str:
    """State vectors s1..sn from s0 by the transition table ``p``."""
    return ",\n".join(
        f"""v{i + 1} AS (SELECT s.metric_id, coalesce("to", cell) AS cell, sum(mass * coalesce(p, 1)) AS mass FROM v{i} s LEFT JOIN {p} ON {p}.metric_id = s.metric_id AND {p}."from" = s.cell GROUP BY 1, 2)"""
        for i in range(n)
    )


@registered(f"""WITH {GRIDS}, {_CHAIN}, v0 AS (SELECT metric_id, min("from") AS cell, 1.0::DOUBLE AS mass FROM tr GROUP BY 1), {_steps("pr", 3)}
SELECT metric_id, cell, round(mass, 6) AS mass FROM v3""")
def n_step_probability(spark, sf_dir):
    moves = G.transitions(_dominant(spark, sf_dir), BY)
    start = moves.groupBy(*BY).agg(F.min("from").alias("cell"))
    return rounded(G.n_step(moves, BY, start, 3), "mass")


@registered(f"""WITH {GRIDS}, {_CHAIN}, ea AS (SELECT metric_id, min("from") AS bottom, max("from") AS top FROM tr GROUP BY 1),
inn AS (SELECT pr.* FROM pr JOIN ea USING (metric_id) WHERE "from" <> bottom AND "from" <> top),
v0 AS (SELECT metric_id, arg_max("from", (n, "from")) AS cell, 1.0::DOUBLE AS mass FROM tr GROUP BY 1), {_steps("inn", 3)}
SELECT metric_id, round(coalesce(sum(mass) FILTER (cell = ea.top), 0), 6) AS top, round(coalesce(sum(mass) FILTER (cell = ea.bottom), 0), 6) AS bottom FROM v3 JOIN ea USING (metric_id) GROUP BY 1""")
def absorption_probability(spark, sf_dir):
    moves = G.transitions(_dominant(spark, sf_dir), BY)
    ends = moves.groupBy(*BY).agg(F.min("from").alias("bottom"), F.max("from").alias("top"))
    start = moves.groupBy(*BY).agg(F.max_by("from", F.struct("n", "from")).alias("cell"))
    return rounded(G.absorption(moves, BY, start, ends, 3), "top", "bottom")


@registered(f"""WITH {GRIDS}, o AS (SELECT metric_id, cell, sum(n) AS n FROM occ GROUP BY 1, 2),
dr AS (SELECT metric_id, "from" AS cell, avg(("to" > "from")::INT) - avg(("to" < "from")::INT) AS drift FROM moves WHERE "to" IS NOT NULL GROUP BY 1, 2),
ti AS (SELECT metric_id, sum(value - p) / sum(abs(value - p)) AS tilt FROM (SELECT *, lag(value) OVER (PARTITION BY metric_id ORDER BY ts, seq) AS p FROM obs) GROUP BY 1),
l AS (SELECT o.*, gmin + (o.cell + 0.5) * step AS price, step, coalesce(drift, 0) / 2 + tilt / 4 AS lean, sum(1 / n) OVER (PARTITION BY o.metric_id) AS inverse
  FROM o JOIN grids USING (metric_id) JOIN ti USING (metric_id) LEFT JOIN dr ON dr.metric_id = o.metric_id AND dr.cell = o.cell)
SELECT metric_id, cell, round(price, 6) AS price, round(least(0.75, greatest(0.25, 0.5 + lean)), 6) AS long_p, round(least(0.75, greatest(0.25, 0.5 - lean)), 6) AS short_p,
 round(1 / n / inverse, 6) AS weight, step > 2 * 0.0004 * price AS pays FROM l""")
def plan_from_grid(spark, sf_dir):
    d = ledger.plan_from_grid(observations(spark, sf_dir), BY, _grid(spark, sf_dir), DAY, risk=0.1, reward=0.2, fee=0.0004)
    return rounded(d, "price", "long_p", "short_p", "weight")


@registered(f"""WITH {GRIDS}, pm AS (SELECT metric_id, avg(("to" > "from")::INT) AS up, avg(("to" < "from")::INT) AS down, avg(("to" = "from")::INT) AS stay FROM moves WHERE "to" IS NOT NULL GROUP BY 1),
la AS (SELECT metric_id, arg_max(cell, (ts, seq)) AS cell FROM placed GROUP BY 1),
w AS (SELECT metric_id, greatest(1, ceil((gmax - gmin) / step))::DOUBLE AS grid_cells, step AS grid_step_price, cell::DOUBLE AS grid_cell_now, gmin AS grid_lo, gmax AS grid_hi,
  up AS grid_up_prob, down AS grid_down_prob, stay AS grid_stay_prob FROM grids JOIN pm USING (metric_id) JOIN la USING (metric_id))
SELECT metric_id, metric, round(value, 6) AS value FROM w UNPIVOT (value FOR metric IN (grid_cells, grid_step_price, grid_cell_now, grid_lo, grid_hi, grid_up_prob, grid_down_prob, grid_stay_prob))""")
def grid_state_metrics(spark, sf_dir):
    return rounded(G.state_metrics(observations(spark, sf_dir), BY, _grid(spark, sf_dir), DAY), "value")


_TREND = """o AS (SELECT metric_id, min(ts) AS t0, max(ts) AS t1 FROM obs GROUP BY 1),
xy AS (SELECT obs.metric_id, ts, seq, t0, t1, (ts - t0)::DOUBLE AS x, value AS y FROM obs JOIN o USING (metric_id)),
f AS (SELECT metric_id, count(*) AS samples, max(x) AS span, any_value(t0) AS t0, any_value(t1) AS t1, regr_slope(y, x) AS slope, regr_intercept(y, x) AS off,
      avg(y) AS m, arg_max(y, (ts, seq)) AS current FROM xy GROUP BY 1),
res AS (SELECT xy.metric_id, y - (off + slope * x) AS r, y - m AS d FROM xy JOIN f USING (metric_id)),
sp AS (SELECT metric_id, sum(r * r) AS sse, sum(d * d) AS sst, quantile_cont(abs(r), 0.95) AS amp FROM res GROUP BY 1),
trend AS (SELECT f.*, sp.* EXCLUDE (metric_id), CASE WHEN abs(slope * span) <= 2 * amp THEN 'flat' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction FROM f JOIN sp USING (metric_id))"""
TREND = f"{OBS}, {_TREND}"


@registered(f"""WITH {TREND} SELECT metric_id, samples, round(slope * 86400, 6) AS slope_day, round(off, 6) AS "offset", round(1 - sse / sst, 6) AS r2,
round(sqrt(sse / (samples - 2)), 6) AS residual_std, round(amp, 6) AS amplitude, direction FROM trend""")
def trend_fit(spark, sf_dir):
    d = trend.trend_fit(observations(spark, sf_dir), BY)
    return rounded(d, "slope_day", "offset", "r2", "residual_std", "amplitude").select("metric_id", "samples", "slope_day", "offset", "r2", "residual_std", "amplitude", "direction")


@registered(f"""WITH {TREND} SELECT metric_id, hours, round(off + slope * (t1 + hours * 3600 - t0), 6) AS value, round(off + slope * (t1 + hours * 3600 - t0) - amp, 6) AS low,
round(off + slope * (t1 + hours * 3600 - t0) + amp, 6) AS high FROM trend, (VALUES (0.0::DOUBLE), (24.0::DOUBLE)) h(hours)""")
def trend_project(spark, sf_dir):
    return rounded(trend.project(trend.trend_fit(observations(spark, sf_dir), BY), BY, [0.0, 24.0]), "value", "low", "high")


_UP = "(off + slope * (t1 - t0) + amp)"
_CAPACITY = f"""{OBS}, {_grids(12, "0.0::DOUBLE", "500.0::DOUBLE", "greatest(1, (t1 - t0) // 64)")},
{_TREND}, mv AS (SELECT metric_id, avg(("to" > "from")::INT) - avg(("to" < "from")::INT) AS drift FROM moves WHERE "to" IS NOT NULL GROUP BY 1),
cf AS (SELECT metric_id, direction, current, 500 - current AS headroom, (500 - current) / 500 AS headroom_rel, amp > 10 AS oscillating, amp / 500 AS amplitude_rel,
  ceil(amp / step)::BIGINT AS envelope_cells, greatest(0, least(greatest(1, ceil(500 / step)) - 1, floor(current / step)))::BIGINT AS current_cell,
  (greatest(1, ceil(500 / step)) - 1)::BIGINT AS top_cell, step, coalesce(drift, 0) AS drift,
  CASE WHEN direction = 'rising' THEN greatest(0, (500 - step - {_UP}) / (slope * 3600)) END AS hours_to_top_cell,
  CASE WHEN direction = 'rising' THEN greatest(0, (500 - {_UP}) / (slope * 3600)) END AS hours_to_full,
  CASE WHEN direction = 'rising' THEN greatest(0, (500 - ({_UP} - amp)) / (slope * 3600)) END AS hours_to_trend_full
  FROM trend JOIN grids USING (metric_id) LEFT JOIN mv USING (metric_id))"""
_CAPACITY_ROUNDED = ["headroom", "headroom_rel", "amplitude_rel", "step", "drift", "hours_to_top_cell", "hours_to_full", "hours_to_trend_full"]


@registered(f"WITH {_CAPACITY} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _CAPACITY_ROUNDED)}) FROM cf")
def capacity_forecast(spark, sf_dir):
    return rounded(trend.capacity_forecast(observations(spark, sf_dir), BY, 500.0), *_CAPACITY_ROUNDED)


@registered(f"""WITH {_CAPACITY} SELECT metric_id, metric, round(coalesce(value, -1), 6) AS value
FROM cf UNPIVOT INCLUDE NULLS (value FOR metric IN (hours_to_top_cell, hours_to_full, hours_to_trend_full))""")
def capacity_report(spark, sf_dir):
    return rounded(trend.capacity_report(trend.capacity_forecast(observations(spark, sf_dir), BY, 500.0), BY), "value")


_RECENT = f"all_obs AS (SELECT * FROM obs0), obs AS (SELECT o.* FROM obs0 o JOIN (SELECT metric_id, max(ts) AS last FROM obs0 GROUP BY 1) USING (metric_id) WHERE ts > last - {10 * DAY})"


@registered(f"""WITH {OBS.replace("obs AS", "obs0 AS", 1)}, {_RECENT}, {_grids(12, "min(value)", "max(value)", str(DAY))},
lt AS (SELECT metric_id, coalesce(user_id, '?') AS label, arg_max(value, (ts, -seq)) AS value FROM obs GROUP BY 1, 2),
c AS (SELECT lt.*, step, gmin, greatest(1, ceil((gmax - gmin) / step)) AS nc, (CASE WHEN value <= gmin THEN 0 WHEN value >= gmax THEN greatest(1, ceil((gmax - gmin) / step)) - 1
  ELSE floor((value - gmin) / step) END)::BIGINT AS cell FROM lt JOIN grids USING (metric_id))
SELECT metric_id, label, value, cell, round(gmin + cell * step, 6) AS low, round(gmin + cell * step + step, 6) AS high, nc::INT AS num_cells FROM c""")
def grid_band_report(spark, sf_dir):
    return rounded(trend.grid_band_report(observations(spark, sf_dir), BY, "user_id", 10 * DAY), "low", "high")


@registered(f"""WITH {TREND} SELECT metric_id, direction, round(CASE WHEN direction = 'rising' THEN greatest(0, (1000 - {_UP}) / (slope * 3600)) END, 6) AS to_envelope,
round(CASE WHEN direction = 'rising' THEN greatest(0, (1000 - ({_UP} - amp)) / (slope * 3600)) END, 6) AS to_trend FROM trend""")
def trend_hours_to(spark, sf_dir):
    t = trend.trend_fit(observations(spark, sf_dir), BY)
    hours = {"to_envelope": trend.hours_to(F.lit(1000.0), upper=True), "to_trend": trend.hours_to(F.lit(1000.0))}
    return rounded(t.select("metric_id", "direction", *[h.alias(n) for n, h in hours.items()]), "to_envelope", "to_trend")


@registered(f"""WITH {GRIDS}, l AS (SELECT metric_id, arg_max(value, (ts, seq)) AS last, max(ts) AS ts FROM obs GROUP BY 1),
p AS (SELECT metric_id, avg(("to" > "from")::INT) - avg(("to" < "from")::INT) AS drift FROM moves WHERE "to" IS NOT NULL GROUP BY 1)
SELECT metric_id, ts, round(last + drift * step, 6) AS forecast, 'grid-transition' AS method FROM l JOIN grids USING (metric_id) JOIN p USING (metric_id)""")
def next_step_forecast(spark, sf_dir):
    return rounded(trend.next_step_forecast(observations(spark, sf_dir), BY, DAY, max_bit=_BITS), "forecast")


@registered(f"""WITH {OBS}, b AS (SELECT metric_id, (ts // 3600 + 1) * 3600 AS ts, avg(value) AS value FROM obs GROUP BY 1, 2),
j AS (SELECT a.metric_id, a.ts, a.seq, a.value, arg_max(b.value, b.ts) AS p, max(b.ts) AS right_ts FROM obs a JOIN b ON a.metric_id = b.metric_id AND b.ts <= a.ts GROUP BY ALL)
SELECT metric_id, ts, seq, right_ts, round(value - p, 6) AS delta, (abs(value - p) <= 25)::INT AS hit FROM j""")
def verify_forecast(spark, sf_dir):
    """As-of join of every event with the newest forecast before it: the mean of the last whole hour."""
    obs = observations(spark, sf_dir).select("metric_id", "ts", "seq", "value")
    hours = timeseries.resample(obs, BY, 3600, "avg", anchor="epoch").select("metric_id", (F.col("bucket") + 3600).alias("ts"), "value")
    d = trend.verify_forecast(obs, hours, BY, 25.0)
    return rounded(d, "delta").select("metric_id", "ts", "seq", "right_ts", "delta", "hit")


# --- ledger -----------------------------------------------------------------------------------------------------


@registered(f"""WITH {LEDGER} SELECT order_id, ts, status, dtype, size, seq FROM led QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, seq DESC, size DESC, entry DESC) = 1""")
def dedup_orders(spark, sf_dir):
    d = ledger.dedup_orders(ledger_table(spark, sf_dir), ["seq", "size", "entry"])
    return d.select("order_id", "ts", "status", "dtype", "size", "seq")


_PNL = """count(*) FILTER (status = 'closed') AS trades, count(*) FILTER (status = 'closed' AND pnl_pct > 0) AS wins,
count(*) FILTER (status = 'closed' AND coalesce(pnl_pct, 0) <= 0) AS losses, count(*) FILTER (status = 'closed' AND dtype = 'long') AS longs,
count(*) FILTER (status = 'closed' AND dtype = 'short') AS shorts, round(coalesce(sum(size * pnl_pct) FILTER (status = 'closed'), 0), 4) AS net_pnl_abs,
round(coalesce(sum(size * pnl_pct) FILTER (status = 'closed' AND pnl_pct > 0), 0), 4) AS gross_profit,
round(coalesce(sum(size * pnl_pct) FILTER (status = 'closed' AND pnl_pct <= 0), 0), 4) AS gross_loss,
round(coalesce(sum(size) FILTER (status = 'closed'), 0), 4) AS notional, count(*) FILTER (status = 'open' AND size > 0) AS open_count,
round(coalesce(sum(size) FILTER (status = 'open' AND size > 0), 0), 4) AS open_notional, count(*) FILTER (status = 'closed' AND size = 0) AS zero_size_rows,
round(coalesce(count(*) FILTER (status = 'closed' AND pnl_pct > 0) / nullif(count(*) FILTER (status = 'closed'), 0), 0), 9) AS win_rate,
round(coalesce(sum(pnl_pct) FILTER (status = 'closed') / nullif(count(*) FILTER (status = 'closed'), 0), 0), 9) AS net_pnl_pct,
round(coalesce(avg(pnl_pct) FILTER (status = 'closed' AND pnl_pct > 0), 0), 9) AS avg_win_pct,
round(coalesce(avg(pnl_pct) FILTER (status = 'closed' AND pnl_pct <= 0), 0), 9) AS avg_loss_pct"""
_PNL_MONEY = ["net_pnl_abs", "gross_profit", "gross_loss", "notional", "open_notional"]
_PNL_RATES = ["win_rate", "net_pnl_pct", "avg_win_pct", "avg_loss_pct"]


def _pnl(d: DataFrame, *keys: str) -> DataFrame:
    return rounded(rounded(d, *_PNL_MONEY, digits=4), *_PNL_RATES, digits=9)


@registered(f"""WITH {LEDGER}, e AS (SELECT unnest(range(min(ts) // 604800 * 604800, max(ts) + 1, 604800))::BIGINT AS bucket FROM led),
l AS (SELECT *, (ts // 604800) * 604800 AS bucket FROM led) SELECT e.bucket, {_PNL} FROM e LEFT JOIN l USING (bucket) GROUP BY 1""")
def pnl_buckets(spark, sf_dir):
    return _pnl(ledger.pnl_buckets(ledger_table(spark, sf_dir), 604_800), "bucket")


@registered(f"WITH {LEDGER} SELECT {_PNL} FROM led")
def pnl_total(spark, sf_dir):
    return _pnl(ledger.pnl_total(ledger_table(spark, sf_dir)))


@registered(f"WITH {LEDGER}, l AS (SELECT *, (ts // 2592000) * 2592000 AS bucket FROM led) SELECT coalesce(bucket, -1)::BIGINT AS bucket, {_PNL} FROM l GROUP BY ROLLUP (bucket)")
def pnl_rollup(spark, sf_dir):
    return _pnl(ledger.pnl_rollup(ledger_table(spark, sf_dir), 2_592_000).fillna(-1, ["bucket"]), "bucket")


_SIDES = "CASE level % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'short' ELSE 'unknown' END"


@registered(f"""WITH {LEDGER}, l AS (SELECT * REPLACE ({_SIDES} AS dtype) FROM led) SELECT dtype,
round(sum(size * CASE dtype WHEN 'long' THEN (1500 - entry) / entry - 0.0004 WHEN 'short' THEN (entry - 1500) / entry - 0.0004 ELSE 0 END), 4) AS unrealized, count(*) AS positions
FROM l WHERE status = 'open' AND size <> 0 AND entry <> 0 GROUP BY 1""")
def unrealized_pnl(spark, sf_dir):
    """The table's open rows have no side, so sides go by level."""
    d = ledger_table(spark, sf_dir).withColumn("dtype", F.expr(_SIDES))
    return rounded(ledger.unrealized_pnl(d, 1500.0), "unrealized", digits=4)


@registered(f"""WITH {LEDGER}, c AS (SELECT * FROM led WHERE status = 'closed' AND pnl_pct IS NOT NULL),
w AS (SELECT *, sum(pnl_pct) OVER q AS equity, sum((pnl_pct > 0)::INT) OVER q AS won FROM c WINDOW q AS (PARTITION BY grid ORDER BY ts, seq, order_id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT grid, count(*) AS total, round(100 * avg((pnl_pct > 0)::INT), 6) AS win_rate, round(sum(pnl_pct), 6) AS net_pct, round(sum(size * pnl_pct), 4) AS net_abs,
  round(avg(pnl_pct), 9) AS expectancy, round(avg(pnl_pct) * sqrt(count(*)) / stddev_pop(pnl_pct), 6) AS sharpe,
  round(avg((dtype = 'long')::INT), 6) AS long_rate FROM c GROUP BY 1)
SELECT * FROM t""")
def trade_report(spark, sf_dir):
    d = ledger.trade_report(ledger_table(spark, sf_dir), ["grid"])
    d = rounded(rounded(rounded(d, "win_rate", "net_pct", "sharpe", "long_rate"), "net_abs", digits=4), "expectancy", digits=9)
    return d.select("grid", "total", "win_rate", "net_pct", "net_abs", "expectancy", "sharpe", "long_rate")


@registered(f"""WITH {LEDGER}, c AS (SELECT * FROM led WHERE status = 'closed' AND pnl_pct IS NOT NULL),
w AS (SELECT *, sum(pnl_pct) OVER q AS equity, sum((pnl_pct > 0)::INT) OVER q AS won FROM c WINDOW q AS (PARTITION BY grid ORDER BY ts, seq, order_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY grid ORDER BY ts, seq, order_id ROWS UNBOUNDED PRECEDING)) - equity AS dd FROM w),
st AS (SELECT grid, max(n) AS max_losses FROM (SELECT grid, won, count(*) AS n FROM w WHERE pnl_pct <= 0 GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT grid, max(dd) AS mdd, avg(pnl_pct) * sqrt(count(*)) AS e, sum(pnl_pct) AS net, sqrt(avg(CASE WHEN pnl_pct < 0 THEN pnl_pct * pnl_pct ELSE 0 END)) AS dn FROM d GROUP BY 1)
SELECT grid, round(mdd, 6) AS max_drawdown, round(e / dn, 6) AS sortino, round(net / mdd, 6) AS calmar, max_losses FROM g JOIN st USING (grid)""")
def trade_drawdowns(spark, sf_dir):
    d = ledger.trade_report(ledger_table(spark, sf_dir), ["grid"])
    return rounded(d, "max_drawdown", "sortino", "calmar").select("grid", "max_drawdown", "sortino", "calmar", "max_losses")


@registered(f"""WITH {LEDGER}, c AS (SELECT grid, count(*) AS n, avg(pnl_pct) AS e, stddev_pop(pnl_pct) AS sd, sum(size * pnl_pct) AS net FROM led WHERE status = 'closed' AND pnl_pct IS NOT NULL GROUP BY 1)
SELECT grid, round(e * sqrt(n) / sd, 6) AS sharpe, round(net, 4) AS net_pnl FROM c""")
def trade_score(spark, sf_dir):
    r = ledger.trade_report(ledger_table(spark, sf_dir), ["grid"])
    d = ledger.score(r, ["grid"]).withColumnRenamed("score", "sharpe").join(ledger.score(r, ["grid"], "net_pnl").withColumnRenamed("score", "net_pnl"), "grid")
    return rounded(rounded(d, "sharpe"), "net_pnl", digits=4)


@registered(f"WITH {LEDGER} SELECT grid, level, dtype, count(*) FILTER (pnl_pct > 0) AS wins, count(*) FILTER (pnl_pct <= 0) AS losses FROM led WHERE status = 'closed' AND pnl_pct IS NOT NULL GROUP BY 1, 2, 3")
def outcome_counts(spark, sf_dir):
    return ledger.outcome_counts(ledger_table(spark, sf_dir), ["grid", "level", "dtype"])


@registered(f"""WITH {LEDGER} SELECT grid, round(coalesce(avg((coalesce(pnl_pct, 0) >= 0)::INT) FILTER (status = 'closed'), 0), 6) AS win_rate, count(*) FILTER (status = 'closed') AS closed,
count(*) FILTER (status = 'open') AS open, coalesce(sum(size) FILTER (status = 'open'), 0)::DOUBLE AS open_notional,
coalesce(sum(size) FILTER (status = 'open' AND dtype = 'long'), 0)::DOUBLE AS open_long, count(*) FILTER (status = 'open' AND dtype = 'long') AS long_count,
coalesce(sum(size) FILTER (status = 'open' AND dtype = 'short'), 0)::DOUBLE AS open_short, count(*) FILTER (status = 'open' AND dtype = 'short') AS short_count,
round(arg_max(pnl_pct, (ts, seq)) FILTER (status = 'closed' AND pnl_pct IS NOT NULL), 6) AS pnl_last FROM (SELECT * REPLACE ({_SIDES} AS dtype) FROM led) GROUP BY 1""")
def perf_metrics(spark, sf_dir):
    return rounded(ledger.perf_metrics(ledger_table(spark, sf_dir).withColumn("dtype", F.expr(_SIDES)), ["grid"]), "win_rate", "pnl_last")


@registered(f"""WITH {LEDGER}, n AS (SELECT * FROM led WHERE status = 'open' QUALIFY row_number() OVER (PARTITION BY grid, level ORDER BY ts DESC, seq DESC, order_id DESC) = 1)
SELECT grid, level, order_id, ts, size FROM n WHERE order_id NOT IN (SELECT order_id FROM led WHERE status = 'closed')""")
def replay_state(spark, sf_dir):
    return ledger.replay_state(ledger_table(spark, sf_dir)).select("grid", "level", "order_id", "ts", "size")


@registered(f"WITH {LEDGER} SELECT max(ts) >= 900000000 AS processed FROM led")
def already_processed(spark, sf_dir):
    return ledger.already_processed(ledger_table(spark, sf_dir), 900_000_000)


@registered(f"""WITH {LEDGER}, e AS (SELECT grid, min(ts) AS lo, max(ts) AS hi FROM led GROUP BY 1)
SELECT grid, order_id, ts, seq, CASE WHEN ts <= lo + (hi - lo) * 0.8 THEN 'train' ELSE 'test' END AS part FROM led JOIN e USING (grid)""")
def time_split(spark, sf_dir):
    return ledger.time_split(ledger_table(spark, sf_dir), ["grid"]).select("grid", "order_id", "ts", "seq", "part")


_GOV_NOW = 920_000_000


@registered(f"""WITH {LEDGER}, c AS (SELECT *, coalesce(pnl_pct, 0) < 0 AS lost, row_number() OVER (PARTITION BY grid ORDER BY ts DESC, seq DESC) AS i FROM led WHERE status = 'closed'),
f AS (SELECT grid, coalesce(min(i) FILTER (NOT lost) - 1, count(*)) AS streak, avg(lost::INT) AS rate FROM c WHERE i <= 50 GROUP BY 1),
w AS (SELECT grid, avg((NOT lost)::INT) AS win, coalesce(max(ts) FILTER (lost), 0) AS last_fail_ts FROM c GROUP BY 1)
SELECT grid, streak, round(rate, 6) AS fail_rate, round(greatest(0.2, (CASE WHEN streak > 0 THEN 1 - 0.1 * streak ELSE 1 END) * (CASE WHEN rate > 0.4 THEN 1 - 0.5 * (rate - 0.4) ELSE 1 END)), 6) AS risk_scale,
 (CASE WHEN streak > 0 THEN least(1 + streak, 5) ELSE 1 END)::BIGINT AS apply_skip, streak >= 1 AND {_GOV_NOW} - last_fail_ts < {400 * DAY} AS paused,
 round(least(1.5, 1 + greatest(0, (0.7 - win) / 0.7) * 0.5), 6) AS sl_widen, last_fail_ts FROM f JOIN w USING (grid)""")
def risk_governor(spark, sf_dir):
    d = ledger.risk_governor(ledger_table(spark, sf_dir), ["grid"], now=_GOV_NOW, last=50, rate_ref=0.4, soft_streak=0, hard_streak=1, pause_secs=400 * DAY, model_win=0.7, newest_first=True)
    return rounded(d, "fail_rate", "risk_scale", "sl_widen")


@registered(f"""WITH {LEDGER}, c AS (SELECT *, sum((pnl_pct > 0)::INT) OVER (PARTITION BY grid ORDER BY ts, seq, order_id ROWS UNBOUNDED PRECEDING) AS won FROM led WHERE status = 'closed' AND pnl_pct IS NOT NULL)
SELECT grid, min(ts) AS start, count(*) AS length FROM c WHERE pnl_pct <= 0 GROUP BY grid, won""")
def loss_runs(spark, sf_dir):
    return ledger.loss_runs(ledger_table(spark, sf_dir), ["grid"]).select("grid", "start", "length")


def _levels(c: DataFrame) -> DataFrame:
    ends = c.groupBy(*BY).agg(F.min("l").alias("lo"), F.max("h").alias("hi"))
    return ends.select(*BY, F.explode(ledger.uniform_levels(F.col("lo"), F.col("hi"), 21)).alias("price"))


LEVELS = f"""{CANDLES}, ends AS (SELECT metric_id, min(l) AS lo, max(h) AS hi FROM candles GROUP BY 1),
levels AS (SELECT metric_id, lo + (hi - lo) * i / 20 AS price FROM ends, range(21) r(i))"""


@registered(f"WITH {LEVELS} SELECT metric_id, t, round(price, 6) AS price FROM candles JOIN levels USING (metric_id) WHERE price BETWEEN l AND h")
def level_touch(spark, sf_dir):
    c = _candles(spark, sf_dir)
    return rounded(ledger.level_touch(c, _levels(c), BY), "price").select("metric_id", "t", "price")


def _entries(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    bars = with_index(c.withColumn("zero", F.lit(0)), BY, "bar", ts="t", seq="zero").withColumn("bar", F.col("bar") + 1).drop("zero")
    side = F.when(F.col("bar") % 2 == 0, "long").otherwise("short")
    sign = F.when(F.col("bar") % 2 == 0, 1).otherwise(-1)
    e = bars.select(*BY, F.col("bar").cast("string").alias("order_id"), side.alias("dtype"), F.col("c").alias("entry"), (F.col("bar") + 1).alias("unlock_seq"),
                    (F.col("c") * (1 - sign * 0.2)).alias("sl"), (F.col("c") * (1 + sign * 0.3)).alias("tp"))
    return e, bars.select(*BY, "bar", "o", "h", "l", F.col("c").alias("close"))


_BARS = f"""{CANDLES}, bars AS (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY t) AS bar FROM candles),
e AS (SELECT metric_id, bar AS id, c AS entry, bar + 1 AS unlock, CASE WHEN bar % 2 = 0 THEN 1 ELSE -1 END AS sg FROM bars)"""


def _exits(keys: str, p: str) -> str:
    """First exits of the positions ``p(metric_id, keys, entry, sg, sl, tp, unlock)``, as table k."""
    return f"""j AS (SELECT p.metric_id, {keys}, p.entry, p.sg, p.sl, p.tp, b.bar, b.o, CASE WHEN sg = 1 THEN b.l <= sl ELSE b.h >= sl END AS stop, CASE WHEN sg = 1 THEN b.h >= tp ELSE b.l <= tp END AS hit
  FROM {p} p JOIN bars b ON b.metric_id = p.metric_id AND b.bar >= unlock),
k AS (SELECT *, CASE WHEN stop THEN 'sl' ELSE 'tp' END AS reason,
 ((CASE WHEN stop THEN (CASE WHEN sg = 1 THEN least(o, sl) ELSE greatest(o, sl) END) ELSE (CASE WHEN sg = 1 THEN greatest(o, tp) ELSE least(o, tp) END) END) - entry) / entry * sg - 0.0004 AS pnl_pct
 FROM j WHERE stop OR hit QUALIFY row_number() OVER (PARTITION BY metric_id, {keys} ORDER BY bar) = 1)"""


@registered(f"""WITH {_BARS}, p AS (SELECT *, entry * (1 - sg * 0.2) AS sl, entry * (1 + sg * 0.3) AS tp FROM e), {_exits("id", "p")}
SELECT p.metric_id, p.id::VARCHAR AS order_id, k.bar, coalesce(k.reason, 'open') AS reason, round(k.pnl_pct, 6) AS pnl_pct FROM p LEFT JOIN k ON k.metric_id = p.metric_id AND k.id = p.id""")
def barrier_exit(spark, sf_dir):
    e, bars = _entries(_candles(spark, sf_dir))
    return rounded(ledger.barrier_exit(e, bars, BY, max_bars=64), "pnl_pct").select("metric_id", "order_id", "bar", "reason", "pnl_pct")


@registered(f"""WITH {LEVELS}, g AS (SELECT metric_id, list_sort(list(DISTINCT price)) AS g FROM levels GROUP BY 1),
x AS (SELECT candles.metric_id, t, price, g, CASE WHEN price <= (g[1] + g[-1]) / 2 THEN 'long' ELSE 'short' END AS side, greatest(price * 0.1 * 1.5, 1e-12) AS reach
  FROM candles JOIN levels USING (metric_id) JOIN g USING (metric_id) WHERE price BETWEEN l AND h),
y AS (SELECT *, CASE WHEN side = 'long' THEN list_min([v for v in g if v - price >= reach]) ELSE list_max([v for v in g if price - v >= reach]) END AS tp FROM x)
SELECT metric_id, t, round(price, 6) AS price, side, round(tp, 6) AS tp, CASE WHEN tp IS NULL THEN 'no target' WHEN abs(tp - price) / price <= 0.0004 THEN 'within fee' END AS reason FROM y""")
def entry_candidates(spark, sf_dir):
    c = _candles(spark, sf_dir)
    levels = _levels(c)
    d = ledger.entry_candidates(ledger.level_touch(c, levels, BY), levels, BY, min_rr=1.5, sl_pct=0.1, fee=0.0004)
    return rounded(d, "price", "tp").select("metric_id", "t", "price", "side", "tp", "reason")


@registered(f"""WITH {_BARS}, ps AS (SELECT * FROM (VALUES ('a', 0.1, 0.2), ('b', 0.2, 0.3), ('c', 0.3, 0.6)) v(param, s, g)),
ws AS (SELECT * FROM (VALUES ('train', 1, 500), ('test', 500, 1000000)) v("window", a, b)),
p AS (SELECT e.*, param, "window", entry * (1 - sg * s::DOUBLE) AS sl, entry * (1 + sg * g::DOUBLE) AS tp FROM e, ps, ws WHERE unlock >= a AND unlock < b), {_exits('id, param, "window"', "p")},
g AS (SELECT p.param, p."window", count(k.pnl_pct) AS trades, count(*) - count(k.pnl_pct) AS open, coalesce(avg(k.pnl_pct), 0) AS score
  FROM p LEFT JOIN k ON k.metric_id = p.metric_id AND k.id = p.id AND k.param = p.param AND k."window" = p."window" GROUP BY 1, 2),
m AS (SELECT param, sum(score) / 2 AS mean_score FROM g GROUP BY 1)
SELECT param, "window", trades, open, round(score, 6) AS score, round(mean_score, 6) AS mean_score, param = (SELECT arg_max(param, (mean_score, param)) FROM m) AS best FROM g JOIN m USING (param)""")
def param_sweep(spark, sf_dir):
    """Three parameter sets over all entries, in a window to train and one to test."""
    e, bars = _entries(_candles(spark, sf_dir))
    params = spark.createDataFrame([("a", 0.1, 0.2), ("b", 0.2, 0.3), ("c", 0.3, 0.6)], "param string, sl_pct double, tp_pct double")
    d = ledger.param_sweep(e, bars, BY, params, max_bars=64, windows={"train": (1, 500), "test": (500, 1_000_000)})
    return rounded(d, "score", "mean_score")


@registered(f"""WITH {LEDGER}, h AS (SELECT grid, level AS plan, ts % 2 AS h, min(entry) AS lo, max(entry) AS hi, 5 AS levels, count(*) FILTER (pnl_pct > 0) AS wins, count(*) FILTER (pnl_pct <= 0) AS losses
  FROM led WHERE pnl_pct IS NOT NULL GROUP BY 1, 2, 3), n AS (SELECT grid, plan, min(lo) AS lo, max(hi) AS hi, 5 AS levels FROM h GROUP BY 1, 2),
b AS (SELECT n.grid, n.plan, arg_max((h.levels, h.wins, h.losses), (least(n.hi, h.hi) - greatest(n.lo, h.lo), -abs((n.lo + n.hi) / 2 - (h.lo + h.hi) / 2), h.levels, h.wins, h.losses)) AS x
  FROM n JOIN h ON h.grid = n.grid AND h.lo <= n.hi AND h.hi >= n.lo GROUP BY 1, 2)
SELECT n.grid, n.plan, round(lo, 6) AS lo, round(hi, 6) AS hi, levels, coalesce(x[2], 0) AS wins, coalesce(x[3], 0) AS losses FROM n LEFT JOIN b USING (grid, plan)""")
def carry_plan_stats(spark, sf_dir):
    led = ledger_table(spark, sf_dir).where("pnl_pct IS NOT NULL")
    half = led.groupBy("grid", F.col("level").alias("plan"), (F.col("ts") % 2).alias("h")).agg(
        F.min("entry").alias("lo"), F.max("entry").alias("hi"), F.lit(5).alias("levels"), F.count_if(F.col("pnl_pct") > 0).alias("wins"), F.count_if(F.col("pnl_pct") <= 0).alias("losses"))
    new = half.groupBy("grid", "plan").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("levels").alias("levels"))
    return rounded(ledger.carry_plan_stats(new, half.drop("plan", "h"), ["grid"]), "lo", "hi")


@registered(f"""WITH {LEDGER} SELECT grid, round(avg(CASE WHEN p > 0 AND p < 1 THEN greatest(0, (p / 0.5 - (1 - p)) * 0.5) * 0.25 * 1000 ELSE 0 END), 6) AS stake
FROM (SELECT grid, level, avg((pnl_pct > 0)::INT) AS p FROM led WHERE pnl_pct IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def kelly_size(spark, sf_dir):
    p = ledger_table(spark, sf_dir).where("pnl_pct IS NOT NULL").groupBy("grid", "level").agg(F.avg((F.col("pnl_pct") > 0).cast("double")).alias("p"))
    return rounded(p.groupBy("grid").agg(F.avg(ledger.kelly_size(F.col("p"), F.lit(0.5), 0.25, 1000.0)).alias("stake")), "stake")


@registered(f"""WITH {LEDGER} SELECT dtype, round(avg(2 * (greatest(size * entry * 0.0005, 2.0) + 0.5 + size * entry * 0.0001) / (size * entry)), 9) AS fee FROM led GROUP BY 1""")
def fee_model(spark, sf_dir):
    d = ledger_table(spark, sf_dir).withColumn("cv", F.col("size") * F.col("entry"))
    return rounded(d.groupBy("dtype").agg(F.avg(ledger.derivative_fee(F.col("cv"), 0.0005, 2.0, 0.5, 0.0001)).alias("fee")), "fee", digits=9)


# --- indicators -------------------------------------------------------------------------------------------------

_W = "OVER (PARTITION BY metric_id ORDER BY t ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


@registered(f"""WITH {CANDLES} SELECT metric_id, t, round((c - lag(c, 3) OVER q) / lag(c, 3) OVER q, 6) AS roc3, round(avg(c) {_W.format(n=4)}, 6) AS ma5,
round(max(h) {_W.format(n=9)}, 6) AS high10, round(min(l) {_W.format(n=9)}, 6) AS low10, round(1 / (1 + exp(-(c - o) / 100)), 6) AS squashed
FROM candles WINDOW q AS (PARTITION BY metric_id ORDER BY t)""")
def feature_graph(spark, sf_dir):
    d = _candles(spark, sf_dir).withColumn("gain", (F.col("c") - F.col("o")) / 100)
    d = indicators.feature_graph(d, BY, {"roc3": ("roc", "c", 3), "ma5": ("ma", "c", 5), "high10": ("donchian_high", 10), "low10": ("donchian_low", 10), "squashed": ("sigmoid", "gain")})
    return rounded(d, "roc3", "ma5", "high10", "low10", "squashed").select("metric_id", "t", "roc3", "ma5", "high10", "low10", "squashed")


@registered(f"""WITH {CANDLES} SELECT metric_id, t, round(0.5 * c + 0.25 * coalesce(lag(c, 1) OVER q, 0) + 0.125 * coalesce(lag(c, 2) OVER q, 0), 6) AS ema3
FROM candles WINDOW q AS (PARTITION BY metric_id ORDER BY t)""")
def ema(spark, sf_dir):
    d = indicators.sliced_nodes(_candles(spark, sf_dir), BY, 3, lambda rows, keys: rows.withColumn("ema3", indicators.ema(F.col("c"), keys, 3, 3)))
    return rounded(d, "ema3").select("metric_id", "t", "ema3")


_TAIL = "OVER (PARTITION BY metric_id ORDER BY t ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)"


def _aged(x: str, k: str) -> str:
    return f"list_sum([{x}[len({x}) - i] * {k} * pow(1 - {k}, i) for i in range(len({x}))])"


_RSI = f"""{CANDLES}, d AS (SELECT *, coalesce(c - lag(c) OVER q, 0) AS d, lag(c) OVER q AS pc FROM candles WINDOW q AS (PARTITION BY metric_id ORDER BY t)),
w AS (SELECT *, list(greatest(d, 0)) {_TAIL} AS up, list(greatest(-d, 0)) {_TAIL} AS dn, list(greatest(h - l, abs(h - pc), abs(l - pc))) {_TAIL} AS tr FROM d),
ra AS (SELECT *, {_aged("up", "(1 / 14)")} AS g, {_aged("dn", "(1 / 14)")} AS s, {_aged("tr", "(2 / 15)")} AS atr FROM w)"""


@registered(f"WITH {_RSI} SELECT metric_id, t, round(CASE WHEN g + s > 0 THEN g / (g + s) ELSE 0.5 END, 6) AS rsi, round(atr, 6) AS atr FROM ra")
def rsi_atr(spark, sf_dir):
    d = indicators.feature_graph(_candles(spark, sf_dir), BY, {"rsi": ("rsi", "c", 14, 28), "atr": ("atr", 14, 28)})
    return rounded(d, "rsi", "atr").select("metric_id", "t", "rsi", "atr")


@registered(f"""WITH {CANDLES} SELECT metric_id, t, c AS last, round(o + c, 6) AS added, round(o - c, 6) AS taken, round(o * c, 6) AS times, round(o / nullif(c, 0), 6) AS share,
greatest(o, c) AS top, least(o, c) AS low, abs(o - c) AS apart, round(-(o - c), 6) AS turned, round(o - c, 6) AS second FROM candles""")
def feature_operators(spark, sf_dir):
    nodes = {
        "last": ("last", "c"), "added": ("add", "o", "c"), "taken": ("sub", "o", "c"), "times": ("mul", "o", "c"), "share": ("div", "o", "c"), "top": ("max", "o", "c"),
        "low": ("min", "o", "c"), "apart": ("abs", "taken"), "turned": ("neg", "taken"), "both": ("concat", "added", "taken"),
    }
    d = indicators.feature_graph(_candles(spark, sf_dir), BY, nodes).withColumn("second", F.col("both")[1])
    return rounded(d, "added", "taken", "times", "share", "turned", "second").select("metric_id", "t", *[n for n in nodes if n != "both"], "second")


@registered(f"WITH {CANDLES} SELECT metric_id, t, round(0.5 * o - 0.25 * c + 1, 6) AS y0, round(h - l, 6) AS y1 FROM candles")
def linear_head(spark, sf_dir):
    y = indicators.head(["o", "h", "l", "c"], [[0.5, 0, 0, -0.25], [0, 1, -1, 0]], [1.0, 0.0])
    return rounded(_candles(spark, sf_dir).select("metric_id", "t", y[0].alias("y0"), y[1].alias("y1")), "y0", "y1")


@registered(f"""WITH {_RSI}, z AS (SELECT *, (c - o) / c AS bias FROM ra QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY t DESC) = 1)
SELECT metric_id, round(c - 2 * atr + 4 * atr * i / 4, 6) AS price, sign(bias)::DOUBLE AS direction, round(least(1, abs(bias)), 6) AS strength, 0.55::DOUBLE AS win_p FROM z, range(5) r(i)""")
def plan_from_predictions(spark, sf_dir):
    d = indicators.feature_graph(_candles(spark, sf_dir), BY, {"atr": ("atr", 14, 28)}).withColumn("bias", (F.col("c") - F.col("o")) / F.col("c")).withColumn("p", F.lit(0.55))
    p = indicators.plan_from_predictions(d, BY, n_levels=5, width_atr=2.0, bias="bias", win_p="p")
    return rounded(p.select("metric_id", F.explode("levels").alias("price"), "direction", "strength", "win_p"), "price", "strength")


# --- statistics and probability ---------------------------------------------------------------------------------


@registered(f"""WITH {OBS}, m AS (SELECT metric_id, median(value) AS med FROM obs GROUP BY 1), d AS (SELECT metric_id, median(abs(value - med)) AS mad FROM obs JOIN m USING (metric_id) GROUP BY 1)
SELECT metric_id, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.99), 6) AS p99,
round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurtosis, round(any_value(mad), 6) AS mad, round(stddev_samp(value) / avg(value), 6) AS cv FROM obs JOIN d USING (metric_id) GROUP BY 1""")
def describe(spark, sf_dir):
    d = stats.describe(observations(spark, sf_dir), BY)
    return rounded(d, "mean", "std", "p25", "p99", "skew", "kurtosis", "mad", "cv").select("metric_id", "count", "mean", "std", "p25", "p99", "skew", "kurtosis", "mad", "cv")


@registered(f"""WITH {OBS} SELECT metric_id, ts, seq, round(avg(value) OVER w, 6) AS rolling_mean, round(max(value) OVER w, 6) AS rolling_max, round(median(value) OVER w, 6) AS rolling_median
FROM obs WINDOW w AS (PARTITION BY metric_id ORDER BY ts RANGE BETWEEN 7199 PRECEDING AND CURRENT ROW)""")
def rolling(spark, sf_dir):
    d = stats.rolling(observations(spark, sf_dir), BY, 7200, ["mean", "max", "median"])
    return rounded(d, "rolling_mean", "rolling_max", "rolling_median").select("metric_id", "ts", "seq", "rolling_mean", "rolling_max", "rolling_median")


@registered(f"""WITH {OBS} SELECT metric_id, ts, seq, round(CASE WHEN count(*) OVER w > 2 THEN coalesce(skewness(value) OVER w, 0) END, 4) AS rolling_skew,
round(quantile_cont(value, 0.25) OVER w, 6) AS rolling_quantile FROM obs WINDOW w AS (PARTITION BY metric_id ORDER BY ts RANGE BETWEEN 7199 PRECEDING AND CURRENT ROW)""")
def rolling_moments(spark, sf_dir):
    d = stats.rolling(observations(spark, sf_dir), BY, 7200, ["skew", "quantile", "count"], q=0.25)
    d = d.withColumn("rolling_skew", F.when(F.col("rolling_count") > 2, F.coalesce(F.nanvl("rolling_skew", F.lit(0.0)), F.lit(0.0))))
    return rounded(rounded(d, "rolling_skew", digits=4), "rolling_quantile").select("metric_id", "ts", "seq", "rolling_skew", "rolling_quantile")


@registered(f"WITH {OBS} SELECT metric_id, q::DOUBLE AS q, round(v, 6) AS quantile FROM (SELECT metric_id, unnest([0.1, 0.9]) AS q, unnest(quantile_cont(value, [0.1, 0.9])) AS v FROM obs GROUP BY 1)")
def quantiles(spark, sf_dir):
    return rounded(stats.quantile(observations(spark, sf_dir), BY, [0.1, 0.9]), "quantile")


@registered(f"""WITH {OBS}, m AS (SELECT *, value - avg(value) OVER (PARTITION BY metric_id) AS x FROM obs),
l AS (SELECT metric_id, x, lag(x, 1) OVER q AS l1, lag(x, 2) OVER q AS l2 FROM m WINDOW q AS (PARTITION BY metric_id ORDER BY ts, seq)),
s AS (SELECT metric_id, sum(x * x) AS s0, sum(x * l1) AS s1, sum(x * l2) AS s2, count(*) AS n FROM l GROUP BY 1)
SELECT metric_id, 0 AS lag, 1.0::DOUBLE AS acf, 0.0::DOUBLE AS band FROM s UNION ALL SELECT metric_id, 1, round(s1 / s0, 6), round(1.959963984540054 * sqrt(1 / n), 6) FROM s
UNION ALL SELECT metric_id, 2, round(s2 / s0, 6), round(1.959963984540054 * sqrt((1 + 2 * (s1 / s0) * (s1 / s0)) / n), 6) FROM s""")
def acf(spark, sf_dir):
    return rounded(stats.acf(observations(spark, sf_dir), BY, 2), "acf", "band")


@registered()
def pacf(spark, sf_dir):
    return rounded(stats.pacf(observations(spark, sf_dir), BY, 10), "pacf")


@registered()
def adf_test(spark, sf_dir):
    return rounded(stats.adf_test(observations(spark, sf_dir), BY), "statistic", "p_value", "critical_1", "critical_5", "critical_10")


@registered()
def fit_distribution(spark, sf_dir):
    parts = [rounded(stats.fit_distribution(observations(spark, sf_dir), BY, d), "a", "b", "ks", "p_value", digits=5).withColumn("dist", F.lit(d)) for d in ("norm", "expon", "gamma", "lognorm", "weibull")]
    scaled = observations(spark, sf_dir).withColumn("value", F.col("value") / 1000)
    parts.append(rounded(stats.fit_distribution(scaled, BY, "beta"), "a", "b", "ks", "p_value", digits=5).withColumn("dist", F.lit("beta")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_SEASON = f"""{OBS}, v AS (SELECT metric_id, (ts // 3600) * 3600 AS ts, sum(value) AS value FROM obs GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER q - 1 AS i, count(*) OVER (PARTITION BY metric_id) AS n, sum(value) OVER (q ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING) AS mid,
  lag(value, 12) OVER q AS a, lead(value, 12) OVER q AS b FROM v WINDOW q AS (PARTITION BY metric_id ORDER BY ts)),
tr AS (SELECT *, CASE WHEN i >= 12 AND i < n - 12 THEN (mid + (a + b) / 2) / 24 END AS trend FROM i WHERE n >= 48),
m AS (SELECT metric_id, i % 24 AS place, avg(value - trend) AS m FROM tr GROUP BY 1, 2), mm AS (SELECT metric_id, avg(m) AS mm FROM m GROUP BY 1)"""


@registered(f"""WITH {_SEASON} SELECT tr.metric_id, ts, value, round(trend, 6) AS trend, round(m - mm, 6) AS seasonal, round(value - trend - (m - mm), 6) AS resid
FROM tr JOIN m ON m.metric_id = tr.metric_id AND place = i % 24 JOIN mm ON mm.metric_id = tr.metric_id""".replace("ts, value, round(trend", "ts, round(value, 6) AS value, round(trend"))
def seasonal_decompose(spark, sf_dir):
    hourly = timeseries.resample(observations(spark, sf_dir), BY, 3600, "sum", anchor="epoch")
    d = hourly.select("metric_id", F.col("bucket").alias("ts"), F.col("bucket").alias("seq"), "value")
    return rounded(stats.seasonal_decompose(d, BY, 24), "value", "trend", "seasonal", "resid").drop("seq")


@registered()
def holt_winters(spark, sf_dir):
    daily = timeseries.resample(observations(spark, sf_dir), BY, DAY, "sum", anchor="epoch").select("metric_id", F.col("bucket").alias("ts"), F.col("bucket").alias("seq"), "value")
    d = forecast.holt_winters(daily, BY, 3, period=7)
    path = F.posexplode(F.arrays_zip("forecast", "low", "high")).alias("step", "x")
    return rounded(d.select("metric_id", "alpha", "beta", "gamma", "sse", path).select("metric_id", "alpha", "beta", "gamma", "sse", "step", "x.*"), "sse", "forecast", "low", "high", digits=4)


@registered()
def arima_forecast(spark, sf_dir):
    d = forecast.fit_arima(observations(spark, sf_dir), BY, [(2, 0, 1)], steps=5)
    path = F.posexplode(F.arrays_zip("forecast", "low", "high")).alias("step", "x")
    return rounded(d.select("metric_id", "loglik", path).select("metric_id", "loglik", "step", "x.*"), "loglik", "forecast", "low", "high", digits=4)


@registered()
def arima_two_stage(spark, sf_dir):
    return rounded(stats.arima_forecast(observations(spark, sf_dir), BY, (2, 0, 1), 5), "forecast", "low", "high", digits=4)


@registered()
def auto_arima(spark, sf_dir):
    return rounded(forecast.auto_arima(observations(spark, sf_dir), BY).select("metric_id", "p", "d", "q", "aic", "n"), "aic", digits=4)


_RANKED = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r{i}" for i, c in enumerate(("l_quantity", "l_extendedprice")))


@registered(f"""WITH r AS (SELECT {_RANKED} FROM lineitem) SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(corr(r0, r1), 6) AS corr FROM r
UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0::DOUBLE UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0::DOUBLE""")
def rank_correlation(spark, sf_dir):
    return rounded(stats.corr_matrix(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], "spearman"), "corr")


@registered("""SELECT 'l_quantity' AS x, 'l_quantity' AS y, 1.0::DOUBLE AS corr UNION ALL SELECT 'l_quantity', 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 6) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0::DOUBLE""")
def corr_matrix(spark, sf_dir):
    return rounded(stats.corr_matrix(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]), "corr")


@registered(f"""WITH {OBS}, e AS (SELECT metric_id, min(value) AS lo, max(value) AS hi, count(*) AS n FROM obs GROUP BY 1)
SELECT metric_id, least(19, floor((value - lo) / ((hi - lo) / 20)))::INT AS bin, count(*) AS count, round(count(*) / (any_value(n) * ((any_value(hi) - any_value(lo)) / 20)), 9) AS density FROM obs JOIN e USING (metric_id) GROUP BY 1, 2""")
def histogram(spark, sf_dir):
    return rounded(stats.histogram(observations(spark, sf_dir), BY, 20), "density", digits=9).select("metric_id", "bin", "count", "density")


@registered(f"""WITH {OBS}, q AS (SELECT metric_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM obs GROUP BY 1)
SELECT metric_id, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) FILTER (NOT (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers
FROM obs JOIN q USING (metric_id) GROUP BY metric_id, q.q1, q.median, q.q3""")
def box_data(spark, sf_dir):
    return rounded(stats.box_data(observations(spark, sf_dir), BY), "q1", "median", "q3")


@registered(f"WITH {OBS} SELECT DISTINCT metric_id, value, round(count(*) OVER (PARTITION BY metric_id ORDER BY value) / count(*) OVER (PARTITION BY metric_id), 6) AS ecdf FROM obs")
def ecdf(spark, sf_dir):
    return rounded(probability.ecdf(observations(spark, sf_dir), BY), "ecdf")


@registered(f"WITH {OBS} SELECT metric_id, t::DOUBLE AS threshold, round(avg((value > t)::INT), 6) AS probability FROM obs, (VALUES (50), (100)) v(t) GROUP BY 1, 2")
def threshold_exceedance(spark, sf_dir):
    return rounded(probability.threshold_exceedance(observations(spark, sf_dir), BY, [50, 100]), "probability")


@registered(f"""WITH {OBS} SELECT metric_id, round(avg(value), 6) AS mean, round(avg(value) - 1.959963984540054 * stddev_samp(value) / sqrt(count(*)), 6) AS low,
round(avg(value) + 1.959963984540054 * stddev_samp(value) / sqrt(count(*)), 6) AS high FROM obs GROUP BY 1""")
def confidence_interval(spark, sf_dir):
    return rounded(probability.confidence_interval(observations(spark, sf_dir), BY, method="normal"), "mean", "low", "high")


@registered()
def bootstrap_interval(spark, sf_dir):
    return rounded(probability.confidence_interval(observations(spark, sf_dir), BY, method="bootstrap", resamples=500), "mean", "low", "high", digits=1)


@registered(f"""WITH {OBS} SELECT metric_id, round(count(*) FILTER (value > 50 AND value > 100) / count(*), 6) AS joint, round(count(*) FILTER (value > 50 AND value > 100) / count(*) FILTER (value > 50), 6) AS conditional,
round(count(*) FILTER (value > 50) / count(*), 6) AS condition, round(count(*) FILTER (value > 100) / count(*), 6) AS event FROM obs GROUP BY 1""")
def conditional_probability(spark, sf_dir):
    return rounded(probability.conditional_probability(observations(spark, sf_dir), BY, F.col("value") > 50, F.col("value") > 100), "joint", "conditional", "condition", "event")


@registered(f"""WITH {OBS}, q AS (SELECT metric_id, quantile_cont(value, 0.9) AS th FROM obs GROUP BY 1)
SELECT metric_id, round(th, 6) AS threshold, round(avg((value > th)::INT), 6) AS share, round(avg(value) FILTER (value > th), 6) AS mean_above FROM obs JOIN q USING (metric_id) GROUP BY metric_id, th""")
def tail_probability(spark, sf_dir):
    return rounded(probability.tail_probability(observations(spark, sf_dir), BY, 0.9), "threshold", "share", "mean_above")


@registered(f"""WITH {OBS}, q AS (SELECT metric_id, quantile_cont(value, 0.05) AS var FROM obs GROUP BY 1)
SELECT metric_id, round(var, 6) AS var, round(avg(value), 6) AS shortfall FROM obs JOIN q USING (metric_id) WHERE value <= var GROUP BY metric_id, var""")
def expected_shortfall(spark, sf_dir):
    return rounded(probability.expected_shortfall(observations(spark, sf_dir), BY), "var", "shortfall")


@registered(f"""WITH {OBS}, g AS (SELECT metric_id, stddev_samp(value) * pow(count(*), -0.2) AS bw, count(*) AS n, min(value) AS lo, max(value) AS hi FROM obs GROUP BY 1),
h AS (SELECT metric_id, least(255, floor((value - lo) / ((hi - lo) / 256))) AS bin, count(*) AS w FROM obs JOIN g USING (metric_id) GROUP BY 1, 2),
p AS (SELECT g.*, i, lo + (hi - lo) * i / 49 AS z FROM g, range(50) r(i))
SELECT p.metric_id, i::INT AS i, round(z, 6) AS "at", round(sum(w * exp(-pow((z - (lo + (bin + 0.5) * (hi - lo) / 256)) / bw, 2) / 2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) AS density
FROM p JOIN h USING (metric_id) GROUP BY metric_id, i, z""")
def kernel_density(spark, sf_dir):
    return rounded(probability.density(observations(spark, sf_dir), BY, 50, 256), "at", "density")


@registered("""WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1, count(*) AS n FROM lineitem),
b AS (SELECT least(19, floor((l_quantity - x0) / (x1 - x0) * 20)) AS bx, least(19, floor((l_extendedprice - y0) / (y1 - y0) * 20)) AS yb, e.* FROM lineitem, e)
SELECT round(x0 + (bx + 0.5) * (x1 - x0) / 20, 6) AS x, round(y0 + (yb + 0.5) * (y1 - y0) / 20, 6) AS y, count(*) AS count, round(count(*) / (n * ((x1 - x0) / 20) * ((y1 - y0) / 20)), 9) AS density
FROM b GROUP BY bx, yb, x0, x1, y0, y1, n""")
def joint_density(spark, sf_dir):
    return rounded(probability.joint_density(table(spark, sf_dir, "lineitem"), [], "l_quantity", "l_extendedprice"), "x", "y").withColumn("density", F.round("density", 9))


# --- capacity ---------------------------------------------------------------------------------------------------

_RUNS = f"""WITH {OBS}, u AS (SELECT *, (value > 80)::INT AS up, lag((value > 80)::INT) OVER (PARTITION BY metric_id ORDER BY ts, seq) AS b FROM obs),
r AS (SELECT *, sum((coalesce(b, -1) <> up)::INT) OVER (PARTITION BY metric_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM u),
g AS (SELECT metric_id, run, up, min(ts) AS start, max(ts) AS last, max(value) AS peak, avg(value) AS mean, count(*) AS points FROM r GROUP BY 1, 2, 3),
e AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY metric_id ORDER BY run), last) AS "end" FROM g)"""


@registered(f'{_RUNS} SELECT metric_id, start, "end", "end" - start AS duration, peak, round(mean, 6) AS mean, points FROM e WHERE up = 1')
def peaks(spark, sf_dir):
    return rounded(capacity.peaks(observations(spark, sf_dir), BY, 80.0), "mean")


@registered(f'{_RUNS} SELECT metric_id, count(*) AS peaks, sum("end" - start)::BIGINT AS total_secs, max("end" - start) AS longest, max(peak) AS highest FROM e WHERE up = 1 GROUP BY 1')
def peak_summary(spark, sf_dir):
    return capacity.peak_summary(observations(spark, sf_dir), BY, 80.0)


@registered(f"""WITH {OBS} SELECT metric_id, round(avg((value > 80)::INT), 6) AS probability, arg_max(value, (ts, seq)) AS current FROM obs GROUP BY 1""")
def prob_exceed(spark, sf_dir):
    return rounded(capacity.prob_exceed(observations(spark, sf_dir), BY, 80.0), "probability").select("metric_id", "probability", "current")


_INDEXED = f"WITH {OBS}, i AS (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY ts, seq) - 1 AS x FROM obs)"


@registered(f"{_INDEXED} SELECT metric_id, count(*) AS n, round(regr_slope(value, x), 9) AS slope, round(regr_intercept(value, x), 6) AS intercept, round(regr_r2(value, x), 6) AS r2 FROM i GROUP BY 1")
def growth_rate(spark, sf_dir):
    d = capacity.growth_rate(observations(spark, sf_dir), BY)
    return rounded(rounded(d, "slope", digits=9), "intercept", "r2").select("metric_id", "n", "slope", "intercept", "r2")


_LATEST = f"{_INDEXED}, cu AS (SELECT metric_id, arg_max(value, (ts, seq)) AS current FROM obs GROUP BY 1)"


@registered(f"""{_LATEST}, g AS (SELECT metric_id, regr_slope(value, x) AS slope, regr_slope(ln(value + 1e-10), x) AS rate FROM i GROUP BY 1)
SELECT metric_id, days, model, round(CASE model WHEN 'linear' THEN current + slope * 86400 * days ELSE current * pow(1 + (exp(rate) - 1) * 86400, days) END, 6) AS value
FROM g JOIN cu USING (metric_id), (VALUES (0.001::DOUBLE, 'linear'), (0.01, 'linear'), (1, 'exponential'), (2, 'exponential')) d(days, model)""")
def projection(spark, sf_dir):
    obs = observations(spark, sf_dir)
    parts = [capacity.projection(obs, BY, days, m).withColumn("model", F.lit(m)) for m, days in (("linear", [0.001, 0.01]), ("exponential", [1.0, 2.0]))]
    return rounded(parts[0].unionByName(parts[1]), "value")


@registered(f"""{_INDEXED}, m AS (SELECT metric_id, avg(x) AS mx, stddev_pop(x) AS sx, max(x) AS last FROM i GROUP BY 1), u AS (SELECT *, (x - mx) / sx AS u, value AS y FROM i JOIN m USING (metric_id)),
s AS (SELECT metric_id, count(*) AS n, any_value(mx) AS mx, any_value(sx) AS sx, any_value(last) AS last, sum(pow(u, 3)) AS u3, sum(pow(u, 4)) AS u4, sum(y) AS y0, sum(y * u) AS y1, sum(y * u * u) AS y2 FROM u GROUP BY 1),
c AS (SELECT *, (n * y2 - n * y0 - u3 * y1) / (n * u4 - n * n - u3 * u3) AS c2 FROM s), d AS (SELECT *, (y1 - u3 * c2) / n AS c1, y0 / n - c2 AS c0, (last + 864 - mx) / sx AS v FROM c)
SELECT metric_id, 0.01::DOUBLE AS days, round(c0 + c1 * v + c2 * v * v, 4) AS value FROM d""")
def polynomial_projection(spark, sf_dir):
    return rounded(capacity.projection(observations(spark, sf_dir), BY, [0.01], "quadratic"), "value", digits=4)


@registered(f"""{_LATEST}, g AS (SELECT metric_id, regr_slope(value, x) AS slope, regr_slope(ln(value + 1e-10), x) AS rate FROM i GROUP BY 1),
b AS (SELECT metric_id, current, model, CASE model WHEN 'linear' THEN slope ELSE rate END AS r FROM g JOIN cu USING (metric_id), (VALUES ('linear'), ('exponential')) m(model)),
t AS (SELECT *, CASE WHEN current >= 500 THEN 'ALREADY_EXCEEDED' WHEN r <= 0 THEN 'NOT_GROWING' ELSE 'PROJECTED' END AS status FROM b)
SELECT metric_id, model, status, current, round(CASE status WHEN 'ALREADY_EXCEEDED' THEN 0 WHEN 'PROJECTED' THEN (CASE model WHEN 'linear' THEN (500 - current) / r ELSE ln(500 / current) / r END) END, 2) AS steps_left FROM t""")
def time_to_exhaustion(spark, sf_dir):
    obs = observations(spark, sf_dir)
    parts = [capacity.time_to_exhaustion(obs, BY, 500.0, m).withColumn("model", F.lit(m)) for m in ("linear", "exponential")]
    return rounded(parts[0].unionByName(parts[1]), "steps_left", digits=2)


@registered(f"WITH {OBS} SELECT metric_id, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.9999), 6) AS p99_99, count(value) AS count FROM obs GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return rounded(capacity.latency_percentiles(observations(spark, sf_dir), BY), "p50", "p99", "p99_99").select("metric_id", "p50", "p99", "p99_99", "count")


@registered(f"""WITH {OBS}, q AS (SELECT metric_id, quantile_cont(value, 0.9) AS th, count(*) AS n FROM obs GROUP BY 1)
SELECT metric_id, round(th, 6) AS threshold, count(*) AS tail, round(count(*) / n, 6) AS share, round(avg(value), 6) AS tail_mean, max(value) AS tail_max,
round(count(*) / (sum(ln(value)) - count(*) * ln(min(value))), 5) AS pareto_alpha FROM obs JOIN q USING (metric_id) WHERE value > th GROUP BY metric_id, th, n""")
def latency_tail(spark, sf_dir):
    return rounded(rounded(capacity.latency_tail(observations(spark, sf_dir), BY, 0.9), "threshold", "share", "tail_mean"), "pareto_alpha", digits=5)


# --- text, exposition, functions --------------------------------------------------------------------------------

_PATTERNS = ["tion", "password=", "License", "zzzz"]
_HIT = " OR ".join(f"contains(text, '{p}')" for p in _PATTERNS)


@registered(f"SELECT 4 AS patterns, count(*) FILTER ({_HIT}) AS hits, count(*) FILTER (text IS NULL OR NOT ({_HIT})) AS misses FROM documents")
def pattern_stats(spark, sf_dir):
    return text.pattern_stats(table(spark, sf_dir, "documents"), _PATTERNS)


@registered("""WITH p AS (SELECT DISTINCT text AS pattern FROM benchmark WHERE text <> '')
SELECT doc_id, pattern FROM documents JOIN p ON contains(text, pattern)""")
def pattern_hits(spark, sf_dir):
    """Documents that hold a whole benchmark passage."""
    p = table(spark, sf_dir, "benchmark").select(F.col("text").alias("pattern"))
    return text.pattern_hits(table(spark, sf_dir, "documents"), p, "doc_id")


def _catalog(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("key"), F.col("p_brand").alias("meta"))


@registered("SELECT p_name AS key, arg_min(p_brand, p_partkey) AS meta FROM part GROUP BY 1")
def catalog_insert(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    return text.catalog_insert(c.limit(0), c).select("key", "meta")


@registered("SELECT DISTINCT p_name AS key FROM part WHERE contains(p_name, 'e') AND length(p_name) <= 16 ORDER BY 1 LIMIT 20 OFFSET 5")
def catalog_search(spark, sf_dir):
    return text.catalog_search(_catalog(spark, sf_dir), "e", 15, 5, 20).select("key")


@registered("SELECT p_partkey AS record_id, p_name AS key, p_brand AS meta FROM part WHERE starts_with(p_name, 'b')")
def catalog_prefix(spark, sf_dir):
    return text.catalog_prefix(_catalog(spark, sf_dir), "b")


@registered("""WITH k AS (SELECT DISTINCT c_custkey AS k FROM customer) SELECT k % 4 AS part, count(*) AS keys, CASE WHEN k % 4 < 2 THEN count(*) END AS found, true AS few_false FROM k GROUP BY 1""")
def bloom_filter(spark, sf_dir):
    """Two filters of a quarter of the customers each, united; all customers are asked for: every added one is found, of the others at most 3 % are."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    n = c.where("c_custkey % 4 < 2").distinct().count()
    bits, hashes = text.bloom_size(n, 0.01)
    parts = [text.bloom_build(c.where(F.col("c_custkey") % 4 == i), "c_custkey", bits, hashes) for i in (0, 1)]
    g = text.bloom_contains(c, "c_custkey", text.bloom_union(*parts), bits, hashes).groupBy((F.col("c_custkey") % 4).alias("part")).agg(F.count("*").alias("keys"), F.count_if("maybe").alias("found"))
    added = F.col("part") < 2
    return g.select("part", "keys", F.when(added, F.col("found")).alias("found"), (added | (F.col("found") <= 0.03 * F.col("keys") + 2)).alias("few_false"))


@registered(f"""WITH {OBS}, w AS (SELECT *, metric_id || ',k=' || coalesce(k, '') || ',user_id=' || coalesce(user_id, '') AS series FROM obs WHERE ts >= {T0 + 28 * DAY})
SELECT series, arg_max(value, (ts, -seq)) AS value, max(ts) AS ts FROM w GROUP BY 1""")
def latest_series(spark, sf_dir):
    return exposition.latest_series(observations(spark, sf_dir), T0 + 30 * DAY, 2 * DAY).select("series", "value", "ts")


_SERIES = f"""{OBS}, w AS (SELECT metric_id, coalesce(k, '') AS k, coalesce(user_id, '') AS u, arg_max(value, (ts, -seq)) AS value FROM obs WHERE ts >= {T0 + 28 * DAY} GROUP BY 1, 2, 3)"""


@registered(f"""WITH {_SERIES} SELECT 'app_' || metric_id AS name, 2 AS part, 'app_' || metric_id || '{{k="' || k || '",user_id="' || u || '"}} ' || value AS text FROM w
UNION ALL SELECT DISTINCT 'app_' || metric_id, 0, '# HELP app_' || metric_id || ' latest value' FROM w UNION ALL SELECT DISTINCT 'app_' || metric_id, 1, '# TYPE app_' || metric_id || ' gauge' FROM w""")
def render_exposition(spark, sf_dir):
    return exposition.render(exposition.latest_series(observations(spark, sf_dir), T0 + 30 * DAY, 2 * DAY))


@registered(f"""WITH {_SERIES}, n AS (SELECT metric_id || ',k=' || k || ',user_id=' || u AS series, value FROM w) SELECT series, value, (SELECT greatest(count(*) - 50, 0) FROM n) AS dropped FROM n ORDER BY series LIMIT 50""")
def cap_series(spark, sf_dir):
    """The first 50 series and how many others there are: a cap is the feature."""
    s = exposition.latest_series(observations(spark, sf_dir), T0 + 30 * DAY, 2 * DAY)
    return exposition.cap_series(s, 50).select("series", "value").crossJoin(F.broadcast(exposition.dropped_series(s, 50)))


@registered("SELECT event_id, (props->>'k')::BIGINT AS k, 'x' AS source FROM events WHERE TRY_CAST(props->>'k' AS BIGINT) IS NOT NULL")
def json_project(spark, sf_dir):
    return S.json_project(table(spark, sf_dir, "events").select("event_id", "props"), "props", {"k": (".k", "i64")}, {"source": "x"}).drop("props")


@registered("SELECT event_id, len(json_keys(props)) AS n, props->>'k' AS first FROM events")
def json_iterate(spark, sf_dir):
    d = table(spark, sf_dir, "events").withColumn("m", S.json_path(F.col("props"), "[]"))
    return d.select("event_id", F.size("m").alias("n"), F.element_at("m", 1).alias("first"))


@registered("SELECT p_partkey, 'm_' || regexp_replace(regexp_replace(p_name, '[^a-zA-Z0-9_:]', '_', 'g'), '^[0-9]+', '_') AS name FROM part")
def sanitize_metric_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.sanitize_metric_name(F.col("p_name"), "m_").alias("name"))


@registered("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, floor(epoch_us(ts) / 1000000)::BIGINT AS back FROM events")
def iso_round_trip(spark, sf_dir):
    d = observations(spark, sf_dir).select(F.col("seq").alias("event_id"), "ts", S.ts_to_iso(F.col("ts")).alias("iso"))
    return d.select("event_id", "iso", S.iso_to_ts(F.col("iso")).alias("back"))


@registered("SELECT event_type || '_mean' AS metric_id, round(avg(value), 6) AS value FROM events GROUP BY 1")
def registered_transform(spark, sf_dir):
    return rounded(registry.apply("batch_mean", observations(spark, sf_dir)), "value").select("metric_id", "value")


# --- machine learning, anomalies, streams -----------------------------------------------------------------------


@registered()
def linear_regression(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    _, _, w = ml.regression(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"])
    return rounded(w, "weight", digits=3)


@registered()
def regression_scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = None
    for kind in ("ridge", "lasso", "elastic_net", "random_forest", "gradient_boosting"):
        _, s, _ = ml.regression(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"], kind)
        s = rounded(s, "mse", "mae", "r2", digits=3).withColumn("kind", F.lit(kind))
        out = s if out is None else out.unionByName(s)
    return out


_DIM = 64


def _components(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    names = [f"x{i}" for i in range(_DIM)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@registered()
def kmeans(spark, sf_dir):
    e, names = _components(spark, sf_dir)
    _, centroids, _, _ = ml.kmeans(e, names, 5)
    return rounded(centroids, *names)


@registered()
def pca(spark, sf_dir):
    e, names = _components(spark, sf_dir)
    rows, _, _ = ml.pca(e, names)
    return rows.select("vec_id", F.transform("components", lambda v: F.round(v, 6)).alias("components"))


@registered()
def ica(spark, sf_dir):
    e, names = _components(spark, sf_dir)
    rows, _ = ml.ica(e, names)
    return rows.select("vec_id", F.transform("sources", lambda v: F.round(v, 6)).alias("sources"))


@registered()
def isolation_forest(spark, sf_dir):
    d = ml.isolation_forest(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_orderkey", "l_linenumber"])
    return rounded(d, "score").select("l_orderkey", "l_linenumber", "score", "anomaly")


@registered()
def dbscan(spark, sf_dir):
    """Clusters of the plane of an order's quantity and price."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("double").alias("x"), (F.sum("l_extendedprice") / 1000).cast("double").alias("y"))
    return ml.dbscan(li, "x", "y", "l_orderkey", eps=2.0, min_samples=4)


@registered()
def rcf_scores(spark, sf_dir):
    return rounded(anomaly.rcf_scores(observations(spark, sf_dir), BY), "score")


@registered()
def stream_rcf(spark, sf_dir):
    """`rcf_scores` of the events as a stream, forests being its state."""
    return rounded(jobs.run_to_table(anomaly.rcf_stream(_event_stream(spark, sf_dir), BY), name="stream-rcf", state="rocksdb"), "score")


def _event_stream(spark, sf_dir):
    """``events`` read as a file stream, as observations: one trigger takes all files, so no row is late for their order."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return raw.select(F.floor(micros / 1_000_000).cast("bigint").alias("ts"), F.col("event_type").alias("metric_id"), F.col("event_id").alias("seq"), F.col("value").cast("double").alias("value"))


@registered(f"WITH {CANDLES} SELECT * FROM candles WHERE t + 3600 <= (SELECT max(ts) FROM obs)")
def stream_candles(spark, sf_dir):
    return jobs.run_to_table(jobs.candles(_event_stream(spark, sf_dir), BY, 3600), name="stream-candles")


@registered(f"""WITH {OBS}, w AS (SELECT metric_id, value, unnest(range((ts // 3600) * 3600 - 3600, (ts // 3600) * 3600 + 1, 3600))::BIGINT AS start FROM obs)
SELECT metric_id, start, count(*) AS n, round(avg(value), 6) AS mean FROM w WHERE start + 7200 <= (SELECT max(ts) FROM obs) GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    return rounded(jobs.run_to_table(jobs.sliding(_event_stream(spark, sf_dir), BY, 7200, 3600), name="stream-sliding"), "mean")


@registered(f"""{_LAG}, s AS (SELECT *, sum((pt IS NULL OR ts - pt > 1800)::INT) OVER (PARTITION BY metric_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS sid FROM d)
SELECT metric_id, min(ts) AS start, max(ts) + 1800 AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY metric_id, sid HAVING max(ts) + 1800 <= (SELECT max(ts) FROM obs)""")
def stream_sessions(spark, sf_dir):
    return rounded(jobs.run_to_table(jobs.sessions(_event_stream(spark, sf_dir), BY, 1800), name="stream-sessions"), "total", digits=4)


@registered(f"WITH {CANDLES} SELECT metric_id, t, o, h, l, c, v FROM candles QUALIFY t < max(t) OVER (PARTITION BY metric_id)")
def stream_volume_candles(spark, sf_dir):
    d = _event_stream(spark, sf_dir).withColumn("quantity", F.lit(1.0))
    return jobs.run_to_table(jobs.volume_candles(d, BY, 3600), name="stream-volume")
