"""Registered queries of models, replays, settings and sinks that the other modules lack, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import capacity, concordance, density_clusters, ledger, ml, probability, query, stats, text, timeseries, trend
from tidemark.plans import registry
from tidemark.plans.queries import _BARS, BY, DAY, LEDGER, OBS, T0, _candles, _entries, _event_stream, _exits, registered, rounded
from tidemark.plans.source_queries import _order_observations
from tidemark.schema import ledger as ledger_table
from tidemark.schema import observations, table
from tidemark.sources import io
from tidemark.sources.scratch import scratch_path
from tidemark.streaming import jobs

# --- models ------------------------------------------------------------------------------------------------------


@registered("""WITH p AS (SELECT c_custkey AS k, c_acctbal::DOUBLE AS x, c_nationkey::DOUBLE AS y FROM customer),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y))::DOUBLE AS s, sum((a.x = b.x)::INT)::DOUBLE AS tx, sum((a.y = b.y)::INT)::DOUBLE AS ty, count(*)::DOUBLE AS n FROM p a JOIN p b ON a.k < b.k)
SELECT (SELECT count(*) FROM p) AS n, round(s / sqrt((n - tx) * (n - ty)), 6) AS tau FROM s""")
def kendall_tau(spark, sf_dir):
    return rounded(concordance.kendall_tau(table(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey"), "tau")


_DIMS = 64


@registered("""WITH RECURSIVE e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.id AS i, b.id AS j FROM e a JOIN e b ON list_distance(a.v, b.v) <= 1.2),
core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 4),
links AS (SELECT near.i, near.j FROM near JOIN core a ON a.i = near.i JOIN core b ON b.i = near.j),
r(i, c) AS (SELECT i, i FROM core UNION SELECT links.j, r.c FROM r JOIN links ON links.i = r.i),
cl AS (SELECT i, min(c) AS c FROM r GROUP BY i)
SELECT e.id AS vec_id, coalesce(own.c, (SELECT min(cl.c) FROM near JOIN cl ON cl.i = near.j WHERE near.i = e.id), -1) AS cluster, own.c IS NOT NULL AS core FROM e LEFT JOIN cl own ON own.i = e.id""")
def dbscan_vectors(spark, sf_dir):
    """All 64 components of the embeddings."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(_DIMS)])
    return density_clusters.dbscan(d, [f"f{i}" for i in range(_DIMS)], "vec_id", eps=1.2, min_samples=4, scaler=None)


@registered(f"""WITH {OBS}, m AS (SELECT metric_id, ts, seq, value - avg(value) OVER (PARTITION BY metric_id) AS x FROM obs),
l AS (SELECT metric_id, x, lag(x, 1) OVER q AS l1, lag(x, 2) OVER q AS l2, lag(x, 3) OVER q AS l3 FROM m WINDOW q AS (PARTITION BY metric_id ORDER BY ts, seq)),
s AS (SELECT metric_id, sum(x * l1) / sum(x * x) AS a, sum(x * l2) / sum(x * x) AS b, sum(x * l3) / sum(x * x) AS c FROM l GROUP BY 1),
p AS (SELECT *, (b - a * a) / (1 - a * a) AS p2 FROM s),
q AS (SELECT *, a * (1 - p2) AS f1 FROM p)
SELECT metric_id, 0 AS lag, 1.0::DOUBLE AS pacf FROM q UNION ALL SELECT metric_id, 1, round(a, 6) FROM q UNION ALL SELECT metric_id, 2, round(p2, 6) FROM q
UNION ALL SELECT metric_id, 3, round((c - f1 * b - p2 * a) / (1 - f1 * a - p2 * b), 6) FROM q""")
def pacf_first_lags(spark, sf_dir):
    return rounded(stats.pacf(observations(spark, sf_dir), BY, 3).select("metric_id", F.col("lag").cast("int").alias("lag"), "pacf"), "pacf")


@registered()
def acf_whole(spark, sf_dir):
    return rounded(stats.acf(observations(spark, sf_dir), BY), "acf", "band")


@registered()
def pacf_whole(spark, sf_dir):
    return rounded(stats.pacf(observations(spark, sf_dir), BY), "pacf")


@registered("""WITH d AS (SELECT ps_q AS x, ps_p AS y FROM (SELECT l_quantity::DOUBLE AS ps_q, l_extendedprice::DOUBLE AS ps_p FROM lineitem))
SELECT 'x' AS feature, round(regr_slope(y, x), 3) AS weight FROM d""")
def simple_regression(spark, sf_dir):
    """Least squares over all rows; none is held out."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return rounded(ml.linear_weights(d, "y", ["x"]).where("feature = 'x'"), "weight", digits=3)


@registered("""WITH d AS (SELECT l_quantity::DOUBLE AS a, l_discount::DOUBLE * 100 AS b, l_extendedprice::DOUBLE AS y FROM lineitem),
m AS (SELECT count(*) AS n, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM d),
r AS (SELECT *, aa + 1000.0 / n AS ra, bb + 1000.0 / n AS rb FROM m)
SELECT 'a' AS feature, round((ay * rb - by_ * ab) / (ra * rb - ab * ab), 3) AS weight FROM r UNION ALL SELECT 'b', round((by_ * ra - ay * ab) / (ra * rb - ab * ab), 3) FROM r""")
def ridge_weights(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), (F.col("l_discount").cast("double") * 100).alias("b"), F.col("l_extendedprice").cast("double").alias("y"))
    return rounded(ml.linear_weights(d, "y", ["a", "b"], alpha=1000.0).where("feature <> 'intercept'"), "weight", digits=3)


@registered(f"""WITH {OBS}, g AS (SELECT metric_id, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM obs GROUP BY 1)
SELECT metric_id, round(m, 6) AS mean, n FROM g""")
def bootstrap_mean(spark, sf_dir):
    """The bootstrap's own mean lies within a thousandth of the deviation of the sample's; the sample's is returned."""
    obs = observations(spark, sf_dir)
    b = probability.confidence_interval(obs, BY, method="bootstrap").select("metric_id", F.col("mean").alias("b"), "low", "high")
    g = obs.groupBy("metric_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    sound = (F.abs(F.col("b") - F.col("mean")) < 0.2 * F.col("sd") / F.sqrt("n")) & F.col("mean").between(F.col("low"), F.col("high"))
    return rounded(g.join(b, "metric_id").where(sound), "mean").select("metric_id", "mean", "n")


@registered()
def t_interval(spark, sf_dir):
    return rounded(probability.confidence_interval(observations(spark, sf_dir), BY), "mean", "low", "high")


@registered(f"""WITH {OBS}, g AS (SELECT metric_id, min(ts) AS t0 FROM obs GROUP BY 1), d AS (SELECT obs.*, (ts - t0)::DOUBLE AS x FROM obs JOIN g USING (metric_id)),
f AS (SELECT metric_id, regr_slope(value, x) AS b, regr_intercept(value, x) AS a, max(value) - min(value) AS width, max(x) AS span FROM d GROUP BY 1),
r AS (SELECT metric_id, quantile_cont(abs(value - a - b * x), 0.95) AS amp FROM d JOIN f USING (metric_id) GROUP BY 1)
SELECT metric_id, round(span, 6) AS span, round(b * 3600, 6) AS slope_hour, round(b * 86400, 6) AS slope_day, round(amp / width, 6) AS amplitude_rel FROM f JOIN r USING (metric_id)""")
def trend_accessors(spark, sf_dir):
    return rounded(trend.trend_fit(observations(spark, sf_dir), BY).select("metric_id", "span", "slope_hour", "slope_day", "amplitude_rel"), "span", "slope_hour", "slope_day", "amplitude_rel")


# --- orders -------------------------------------------------------------------------------------------------------


@registered(f"""WITH RECURSIVE {_BARS}, p AS (SELECT *, entry * (1 - sg * 0.2) AS sl, entry * (1 + sg * 0.3) AS tp FROM e), {_exits("id", "p")},
d AS (SELECT p.metric_id, floor(p.entry / 50)::BIGINT AS level, p.id::VARCHAR AS oid, p.unlock, k.bar FROM p LEFT JOIN k ON k.metric_id = p.metric_id AND k.id = p.id),
s AS (SELECT *, row_number() OVER (PARTITION BY metric_id, level ORDER BY unlock, oid) AS i FROM d),
nxt AS (SELECT s.metric_id, s.level, s.i, min(n.i) AS j FROM s JOIN s n ON n.metric_id = s.metric_id AND n.level = s.level AND n.unlock > s.bar GROUP BY 1, 2, 3),
r AS (SELECT metric_id, level, 1::BIGINT AS i FROM s WHERE i = 1 UNION ALL SELECT r.metric_id, r.level, nxt.j FROM r JOIN nxt ON nxt.metric_id = r.metric_id AND nxt.level = r.level AND nxt.i = r.i)
SELECT s.metric_id, s.oid AS order_id, s.bar FROM r JOIN s USING (metric_id, level, i)""")
def one_open_per_level(spark, sf_dir):
    e, bars = _entries(_candles(spark, sf_dir))
    exits = ledger.barrier_exit(e, bars, BY, max_bars=64)
    e = e.withColumn("level", F.floor(F.col("entry") / 50))
    return ledger.one_open_per_level(e, exits, BY).select("metric_id", "order_id", "bar")


@registered(f"""WITH {LEDGER}, d AS (SELECT grid AS strategy, order_id, level, ts, seq, status, dtype, entry FROM led),
c AS (SELECT DISTINCT strategy, order_id FROM d WHERE status = 'closed' AND dtype IN ('long', 'short') AND entry > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY strategy, level ORDER BY ts DESC, seq DESC, order_id DESC) AS rn FROM d WHERE status <> 'closed' AND dtype IN ('long', 'short') AND entry > 0)
SELECT 'history' AS part, strategy, count(*) AS n, max(ts) AS newest FROM d WHERE status = 'closed' AND dtype IN ('long', 'short') AND entry > 0 GROUP BY 2
UNION ALL SELECT 'faults', strategy, count(*), max(ts) FROM d WHERE NOT (dtype IN ('long', 'short') AND entry > 0) GROUP BY 2
UNION ALL SELECT 'open', o.strategy, count(*), max(ts) FROM o WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.strategy = o.strategy AND c.order_id = o.order_id) GROUP BY 2""")
def replay(spark, sf_dir):
    """The ledger as a log of order observations, and the session that it stands for."""
    led = ledger_table(spark, sf_dir)
    text = {c: F.col(c).cast("string") for c in ("order_id", "status", "dtype", "grid", "level", "size", "pnl_pct")}
    labels = F.map_filter(F.create_map(*[x for k, v in text.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    log = led.select(F.col("grid").alias("strategy"), "ts", "seq", F.col("entry").alias("value"), labels.alias("labels"), F.lit("order").alias("signal"))
    found = ledger.replay(log, ["strategy"])
    out = None
    for part in ("history", "faults", "open"):
        d = found[part].groupBy("strategy").agg(F.count("*").alias("n"), F.max("ts").alias("newest")).select(F.lit(part).alias("part"), "strategy", "n", "newest")
        out = d if out is None else out.unionByName(d)
    return out


# --- settings, sources and sinks -----------------------------------------------------------------------------------


@registered(f"""WITH {OBS}, w AS (SELECT metric_id, min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM obs GROUP BY 1)
SELECT metric_id, n <= 20000 AND n >= 1 AND hi >= lo AND hi - lo <= 30 * 86400 AS accepted FROM w""")
def check_query_bounds(spark, sf_dir):
    """Whether each metric's whole span may be asked for with its row count as limit."""
    def accepted(lo: int, hi: int, n: int) -> bool:
        try:
            query.check_query_bounds(lo, hi, n)
        except ValueError:
            return False
        return True

    def run(batches):
        for pdf in batches:
            yield pdf[["metric_id"]].assign(accepted=[accepted(*r) for r in pdf[["lo", "hi", "n"]].itertuples(index=False)])

    w = observations(spark, sf_dir).groupBy("metric_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n"))
    return w.mapInPandas(run, "metric_id string, accepted boolean")


@registered(f"""WITH {OBS}, r AS (SELECT * FROM (VALUES ('5m', 300), ('1h', 3600), ('1d', 86400), ('1w', 604800)) v(name, secs))
SELECT name, count(DISTINCT (metric_id, ts // secs)) AS buckets FROM obs, r GROUP BY 1""")
def resolutions(spark, sf_dir):
    """Buckets of each resolution name, read strictly and leniently."""
    out, obs = None, observations(spark, sf_dir)
    for name in ("5m", "1h", "1d", "1w"):
        strict, lenient = timeseries.parse_resolution(name), timeseries.resolution_secs(name)
        b = obs.select("metric_id", timeseries.bucket_align(F.col("ts"), strict).alias("a"), timeseries.bucket_align(F.col("ts"), lenient).alias("b")).where("a = b")
        d = b.select("metric_id", "a").distinct().agg(F.count("*").alias("buckets")).select(F.lit(name).alias("name"), "buckets")
        out = d if out is None else out.unionByName(d)
    return out


@registered(f"WITH {OBS} SELECT metric_id, count(*) AS n, round(sum(value), 4) AS total FROM obs GROUP BY 1")
def scan(spark, sf_dir):
    """Observations written as a table, scanned, passed by the null sink and summed."""
    path = scratch_path(spark, "scanned")
    observations(spark, sf_dir).write.parquet(path)
    d = io.scan(spark, path)
    io.null_sink(d)
    return rounded(d.groupBy("metric_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


@registered(f"WITH {OBS} SELECT metric_id, ts, seq, value FROM obs")
def export_arrow(spark, sf_dir):
    """Rows of a result as Arrow files, one for each block of a task's rows, read again."""
    d = observations(spark, sf_dir).select("metric_id", "ts", "seq", "value")
    path = scratch_path(spark, "arrow")
    io.export_arrow_parts(d, path)
    return io.read_arrow_parts(spark, path, d.schema)


@registered(f"WITH {OBS} SELECT metric_id, ts, round(value, 6) AS value FROM obs")
def parse_prometheus_matrix(spark, sf_dir):
    """Each metric's day as a range response: one series with all its samples."""
    day = observations(spark, sf_dir).groupBy("metric_id", F.floor(F.col("ts") / DAY).alias("day")).agg(F.collect_list(F.array(F.col("ts").cast("string"), F.col("value").cast("string"))).alias("values"))
    series = F.struct(F.create_map(F.lit("__name__"), F.col("metric_id")).alias("metric"), "values")
    body = F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.lit("matrix").alias("resultType"), F.array(series).alias("result")).alias("data")))
    samples, _ = io.parse_prometheus(day.select(body.alias("body")), "body")
    return rounded(samples.select("metric_id", "ts", "value"), "value")


# --- streams ------------------------------------------------------------------------------------------------------

_WEEK = 7 * DAY
_ARRIVALS = f"""{OBS}, a AS (SELECT metric_id, ts, seq, value, ts // {_WEEK} + (user_id::BIGINT % 5 = 0)::INT AS arrival FROM obs),
w AS (SELECT metric_id, arrival, max(ts) AS top FROM a GROUP BY 1, 2),
c AS (SELECT metric_id, arrival, max(top) OVER (PARTITION BY metric_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM w),
j AS (SELECT a.*, coalesce((ts // 3600 + 1) * 3600 <= seen, false) AS late FROM a JOIN c USING (metric_id, arrival))"""


@registered(f"""WITH {_ARRIVALS}, n AS (SELECT metric_id, max(ts) AS top FROM a GROUP BY 1),
b AS (SELECT metric_id, (ts // 3600) * 3600 AS t, arg_min(value, (ts, seq)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (ts, seq)) AS c, count(*)::DOUBLE AS v FROM j WHERE NOT late GROUP BY 1, 2)
SELECT 'late' AS kind, metric_id, ts AS t, seq, NULL::DOUBLE AS o, NULL::DOUBLE AS h, NULL::DOUBLE AS l, value AS c, NULL::DOUBLE AS v FROM j WHERE late
UNION ALL SELECT 'candle', metric_id, t, NULL, o, h, l, c, v FROM b JOIN n USING (metric_id) WHERE t + 3600 <= top""")
def stream_watch(spark, sf_dir):
    """Candles and late ticks over several triggers: a week's events a trigger, those of every fifth user a week late."""
    return jobs.run_to_table(jobs.tick_watch(_arrivals(spark, sf_dir, BY), BY, 3600, 365 * DAY, delay_secs=60 * DAY), name="watch", state="rocksdb").select("kind", "metric_id", "t", "seq", "o", "h", "l", "c", "v")


def _arrivals(spark, sf_dir, by):
    """The events as a stream that takes one week of arrivals a trigger."""
    d = observations(spark, sf_dir).withColumn("user_id", F.col("labels")["user_id"].cast("bigint"))
    d = d.withColumn("arrival", F.floor(F.col("ts") / _WEEK) + F.when(F.col("user_id") % 5 == 0, 1).otherwise(0)).select(*by, "ts", "seq", "value", "arrival")
    path = scratch_path(spark, "arrivals")
    for (week,) in sorted(d.select("arrival").distinct().collect()):  # a file a week, in the order of arrival
        d.where(F.col("arrival") == week).drop("arrival").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(d.drop("arrival").schema).option("maxFilesPerTrigger", 1).parquet(path)


@registered(f"""WITH {OBS}, a AS (SELECT user_id, ts, ts // {_WEEK} + (user_id::BIGINT % 5 = 0)::INT AS arrival FROM obs),
b AS (SELECT row_number() OVER (ORDER BY arrival) AS i, arrival, max(max(ts)) OVER (ORDER BY arrival) AS clock FROM a GROUP BY arrival),
u AS (SELECT a.user_id, b.i, max(a.ts) AS last FROM b JOIN a ON a.arrival <= b.arrival GROUP BY 1, 2)
SELECT DISTINCT user_id, last AS t FROM u JOIN b ON b.i = u.i - 1 WHERE last + {2 * DAY} < clock
UNION SELECT user_id, last FROM u JOIN b USING (i) WHERE i = (SELECT max(i) FROM b) AND last + {2 * DAY} < clock""")
def stream_silence(spark, sf_dir):
    """Users without an event for two days, told by event-time timers over several triggers."""
    d = _arrivals(spark, sf_dir, ["user_id"])
    found = jobs.run_to_table(jobs.tick_watch(d, ["user_id"], 3600, 2 * DAY, delay_secs=60 * DAY), name="silence", state="rocksdb")
    return found.where("kind = 'stale'").select(F.col("user_id").cast("string").alias("user_id"), "t")


# --- what the first queries of these operators leave out -----------------------------------------------------------


@registered("""SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE '{"limits":{"max":' || s_suppkey || ',"min":1},"name":"' || s_name || '"}' END AS config,
 CASE WHEN s_nationkey % 3 = 0 THEN '/limits/max: there is no limits' END AS problem, CASE WHEN s_nationkey % 3 <> 0 THEN CASE WHEN s_nationkey % 3 = 1 THEN s_nationkey::VARCHAR ELSE 'null' END END AS "from" FROM supplier""")
def config_patch(spark, sf_dir):
    """Each supplier's settings patched by pointer: a field that is there, a new one, and one whose parent is missing."""
    s = table(spark, sf_dir, "supplier")
    limits = F.when(F.col("s_nationkey") % 3 == 1, F.format_string('{"name":"%s","limits":{"min":1,"max":%d}}', "s_name", "s_nationkey")).when(
        F.col("s_nationkey") % 3 == 2, F.format_string('{"name":"%s","limits":{"min":1}}', "s_name")
    ).otherwise(F.format_string('{"name":"%s"}', "s_name"))
    d = s.select("s_suppkey", limits.alias("config"))
    patched, audit = S.config_edit(d, "s_suppkey", "config", "/limits/max", F.col("s_suppkey").cast("string"), F.lit(T0))
    was = audit.select(F.col("labels")["node"].cast("bigint").alias("s_suppkey"), F.col("labels")["from"].alias("from"))
    kept = patched.withColumn("config", F.when(F.col("problem").isNull(), F.col("config")))
    return kept.join(was, "s_suppkey", "left").select("s_suppkey", "config", "problem", "from")


@registered(f"WITH {OBS} SELECT metric_id, round(avg(value * 2 + 1), 6) AS doubled, round(avg(sqrt(abs(value))), 6) AS root FROM obs GROUP BY 1")
def free_functions(spark, sf_dir):
    """A function in SQL and one in Python, under names of the caller's choice."""
    registry.register_function(spark, "twice_and_one", "x DOUBLE", "DOUBLE", "x * 2 + 1")
    registry.register_function(spark, "root_of", "x DOUBLE", "double", lambda x: x.abs() ** 0.5)
    g = observations(spark, sf_dir).groupBy("metric_id").agg(F.expr("avg(twice_and_one(value))").alias("doubled"), F.expr("avg(value)").alias("v"))
    r = observations(spark, sf_dir).select("metric_id", F.expr("root_of(value)").alias("r")).groupBy("metric_id").agg(F.avg("r").alias("root"))
    return rounded(g.drop("v").join(r, "metric_id"), "doubled", "root")


@registered("SELECT e.event_id, to_json({'event_id': event_id, 'event_type': event_type})::VARCHAR AS payload FROM events e")
def alert_texts(spark, sf_dir):
    d = io.alert_payloads(table(spark, sf_dir, "events").select("event_id", "event_type"))
    return d.where("accepted").select("event_id", "payload")


@registered(f"""WITH {OBS}, l AS (SELECT metric_id, arg_max(value, (ts, seq)) AS current, max(ts) AS last FROM obs GROUP BY 1)
SELECT metric_id, round(avg((value > 80)::INT), 6) AS recent, any_value(current) > 80 AS exceeds_now FROM obs JOIN l USING (metric_id) WHERE ts > last - 86400 GROUP BY 1""")
def prob_exceed_recent(spark, sf_dir):
    return rounded(capacity.prob_exceed(observations(spark, sf_dir), BY, 80.0, DAY), "recent").select("metric_id", "recent", "exceeds_now")


@registered(f"""WITH {OBS}, i AS (SELECT *, (row_number() OVER (PARTITION BY metric_id ORDER BY ts, seq) - 1)::DOUBLE AS x FROM obs),
u AS (SELECT metric_id, value AS y, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS u, avg(x) OVER w AS mx, stddev_pop(x) OVER w AS sx FROM i WINDOW w AS (PARTITION BY metric_id)),
s AS (SELECT metric_id, count(*)::DOUBLE AS n, sum(u * u * u) AS u3, sum(u * u * u * u) AS u4, sum(y) AS y0, sum(y * u) AS y1, sum(y * u * u) AS y2, any_value(mx) AS mx, any_value(sx) AS sx FROM u GROUP BY 1),
c AS (SELECT *, (n * y2 - n * y0 - u3 * y1) / (n * u4 - n * n - u3 * u3) AS c2 FROM s)
SELECT metric_id, 'polynomial' AS model, round(c2 / (sx * sx), 9) AS quadratic, round((y1 - u3 * c2) / n / sx - 2 * c2 * mx / (sx * sx), 6) AS slope FROM c
UNION ALL SELECT metric_id, 'exponential', 0.0, round(regr_slope(ln(value + 1e-10), x), 6) FROM i GROUP BY 1""")
def growth_models(spark, sf_dir):
    obs, out = observations(spark, sf_dir), None
    for model in ("polynomial", "exponential"):
        d = capacity.growth_rate(obs, BY, model).select("metric_id", F.lit(model).alias("model"), F.round("quadratic", 9).alias("quadratic"), F.round("slope", 6).alias("slope"))
        out = d if out is None else out.unionByName(d)
    return out


@registered("""SELECT p_partkey, 'unknown placeholder c' AS unknown, 'unterminated placeholder' AS open, 'empty placeholder' AS empty, p_name || '-' || p_brand AS filled FROM part""")
def template_errors(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    values = {"a": F.col("p_name"), "b": F.col("p_brand")}
    problems = {n: S.render_template(t, values)[1] for n, t in (("unknown", "{{a}} {{c}}"), ("open", "{{a}} {{b"), ("empty", "{{ }} {{a}}"))}
    return p.select("p_partkey", *[c.alias(n) for n, c in problems.items()], S.render_template("{{a}}-{{b}}", values)[0].alias("filled"))


@registered("""WITH old AS (SELECT p_name AS key, arg_min(p_brand, p_partkey) AS meta FROM part WHERE p_size <= 25 GROUP BY 1),
new AS (SELECT p_name AS key, arg_min(p_brand, p_partkey) AS meta FROM part WHERE p_size > 25 GROUP BY 1)
SELECT key, meta FROM old UNION ALL SELECT key, meta FROM new WHERE key NOT IN (SELECT key FROM old)""")
def catalog_insert_again(spark, sf_dir):
    """A second batch into a catalog that holds keys: those are rejected."""
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("key"), F.col("p_brand").alias("meta"), "p_size")
    first = text.catalog_insert(c.drop("p_size").limit(0), c.where("p_size <= 25").drop("p_size"))
    return text.catalog_insert(first, c.where("p_size > 25").drop("p_size")).select("key", "meta")


@registered("""WITH k AS (SELECT DISTINCT c_custkey AS k FROM customer) SELECT count(*) AS keys, true AS sound FROM k""")
def bloom_rate(spark, sf_dir):
    """The false positive rate that a filter states, against its formula for the bits that are set."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    n = c.distinct().count()
    bits, hashes = text.bloom_size(n, 0.01)
    stated = text.bloom_fpr(text.bloom_build(c, "c_custkey", bits, hashes), bits, hashes)
    expected = (1 - math.exp(-hashes * n / bits)) ** hashes
    return c.distinct().agg(F.count("*").alias("keys")).crossJoin(stated.select((F.abs(F.col("fpr") - expected) <= 0.25 * expected + 0.001).alias("sound")))


_ORDER_WINDOW = f"""{LEDGER}, w AS (SELECT * FROM led WHERE ts BETWEEN 800000000 - 2592000 AND 800000000),
u AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, seq DESC) = 1), f AS (SELECT * FROM u WHERE dtype IN ('long', 'short') AND entry > 0)"""


@registered(f"""WITH {_ORDER_WINDOW} SELECT dtype, round(sum(size * ((1500.0 - entry) / entry * CASE dtype WHEN 'long' THEN 1 ELSE -1 END - 0.0004)), 4) AS unrealized, count(*) AS positions
FROM f WHERE status = 'open' AND size <> 0 GROUP BY 1""")
def order_values(spark, sf_dir):
    """Open positions of a window at a mark price."""
    found = ledger.orders(_order_observations(spark, sf_dir), now=800_000_000, limit=200, interval="1d", mark=1500.0)
    return rounded(found["unrealized"].where("dtype IN ('long', 'short')"), "unrealized", digits=4).select("dtype", "unrealized", "positions")


@registered("SELECT 'sink' AS node, count(*) || ' rows refused' AS message, count(*) AS refused FROM events")
def stream_fault_rows(spark, sf_dir):
    """What a sink refused, as its fault row tells."""
    faults = scratch_path(spark, "faults")

    def work(batch, batch_id: int) -> None:
        raise ValueError(f"{batch.count()} rows refused")

    q = _event_stream(spark, sf_dir).writeStream.foreachBatch(jobs.tolerant(work, faults, "sink"))
    q.option("checkpointLocation", scratch_path(spark, "faults-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return jobs.current_faults(spark.read.parquet(faults)).select("node", "message", F.regexp_extract("message", "^([0-9]+)", 1).cast("bigint").alias("refused"))


@registered(f"WITH {OBS} SELECT metric_id, count(*) AS n, round(sum(value), 4) AS total FROM obs GROUP BY 1")
def stream_replayed_batch(spark, sf_dir):
    """Every micro-batch is handed to the sink twice, as after a crash between write and commit: rows count once."""
    path = scratch_path(spark, "replayed")
    write = jobs.idempotent_writer(path)

    def twice(batch, batch_id: int) -> None:
        write(batch, batch_id)
        write(batch, batch_id)

    q = _event_stream(spark, sf_dir).select("metric_id", "value").writeStream.foreachBatch(twice)
    q.option("checkpointLocation", scratch_path(spark, "replayed-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    d = spark.read.parquet(path)
    return rounded(d.groupBy("metric_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


@registered(f"""WITH {OBS}, g AS (SELECT metric_id, stddev_samp(value) * pow(count(*), -0.2) AS bw, count(*) AS n, min(value) AS lo, max(value) AS hi FROM obs GROUP BY 1),
h AS (SELECT metric_id, least(1023, floor((value - lo) / ((hi - lo) / 1024))) AS bin, count(*) AS w FROM obs JOIN g USING (metric_id) GROUP BY 1, 2),
p AS (SELECT g.*, i, lo + (hi - lo) * i / 199 AS z FROM g, range(200) r(i))
SELECT p.metric_id, i::INT AS i, round(z, 6) AS "at", round(sum(w * exp(-pow((z - (lo + (bin + 0.5) * (hi - lo) / 1024)) / bw, 2) / 2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) AS density
FROM p JOIN h USING (metric_id) GROUP BY metric_id, i, z""")
def kernel_density_whole(spark, sf_dir):
    return rounded(probability.density(observations(spark, sf_dir), BY), "at", "density")


_PRESETS = ("today", "yesterday", "this_week", "last_week", "this_month", "last_month", "2h", "3d")
_DAY_SQL = "epoch(date_trunc('{u}', to_timestamp(ts) AT TIME ZONE 'UTC'))::BIGINT"
_MONTH_BEFORE = "epoch(date_trunc('month', to_timestamp(ts) AT TIME ZONE 'UTC') - INTERVAL 1 MONTH)::BIGINT"


@registered(f"""WITH {OBS}, s AS (SELECT seq, ts, {_DAY_SQL.format(u="day")} AS d, {_DAY_SQL.format(u="week")} AS w, {_DAY_SQL.format(u="month")} AS m, {_MONTH_BEFORE} AS b FROM obs)
SELECT seq, p.preset, CASE p.preset WHEN 'today' THEN d WHEN 'yesterday' THEN d - 86400 WHEN 'this_week' THEN w WHEN 'last_week' THEN w - 604800 WHEN 'this_month' THEN m WHEN 'last_month' THEN b
  WHEN '2h' THEN ts - 7200 ELSE ts - 259200 END AS lo, CASE p.preset WHEN 'yesterday' THEN d WHEN 'last_week' THEN w WHEN 'last_month' THEN m ELSE ts END AS hi
FROM s, (SELECT unnest({list(_PRESETS)}) AS preset) p""")
def time_presets(spark, sf_dir):
    """All presets at each event's own now."""
    found = []
    for preset in _PRESETS:
        lo, hi = S.range_start(preset, F.col("ts"))
        found.append(F.struct(F.lit(preset).alias("preset"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi")))
    return observations(spark, sf_dir).select("seq", F.explode(F.array(*found)).alias("x")).select("seq", "x.*")
