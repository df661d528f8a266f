"""Candles: aggregation of ticks, conversions, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sliced import with_row_halo
from tidemark.operators.timeseries import bucket_align

FIELDS = ("o", "h", "l", "c", "v")


def tick_price() -> Column:
    """The value if it is finite and positive, else the ``price`` label."""
    value = F.col("value")
    good = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))
    return F.when(good, value).otherwise(F.expr("try_cast(labels['price'] AS double)"))


def tick_to_candle(df: DataFrame, by: list[str], step: int, *, volume: str = "count", quantity: str = "qty") -> DataFrame:
    """Epoch-aligned candles; open and close by arrival (ts, seq); v counts ticks or sums a quantity."""
    d = df.withColumn("price", tick_price()).where("price IS NOT NULL")
    at = F.struct("ts", "seq")
    v = F.count("*").cast("double") if volume == "count" else F.sum(F.col("labels")[quantity].cast("double"))
    return d.groupBy(*by, bucket_align(F.col("ts"), step).alias("t")).agg(
        F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"),
        F.max_by("price", at).alias("c"), v.alias("v"),
    )


def candles_from_observations(df: DataFrame, by: list[str], resolution: str | None = None) -> DataFrame:
    """Observations labelled ``field`` o, h, l, c, v as one row per ts; the last write wins.

    Rows without a ``resolution`` label fit any resolution.
    """
    own = F.col("labels")["resolution"]
    d = df if resolution is None else df.where(own.isNull() | (own == resolution))
    field = F.col("labels")["field"]
    return d.where(field.isin(*FIELDS)).groupBy(*by, F.col("ts").alias("t")).agg(
        *[F.max_by(F.when(field == f, F.col("value")), F.when(field == f, F.col("seq"))).alias(f) for f in FIELDS]
    )


def reconcile(df: DataFrame) -> DataFrame:
    """Missing or non-positive parts filled: from c, else o, else the larger of h and l; v at least 0."""
    def good(c: str) -> Column:
        return F.when(F.col(c) > 0, F.col(c))

    d = df.withColumn("base", F.coalesce(good("c"), good("o"), F.greatest(good("h"), good("l"))))
    d = d.withColumn("o", F.coalesce(good("o"), "base")).withColumn("c", F.coalesce(good("c"), "base"))
    d = d.withColumn("h", F.coalesce(good("h"), F.greatest("o", "c"))).withColumn("l", F.coalesce(good("l"), F.least("o", "c")))
    return d.withColumn("v", F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0))).drop("base")


def candle_to_observations(df: DataFrame, by: list[str]) -> DataFrame:
    """Five observations for each candle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in FIELDS])
    d = df.select(*by, F.col("t").alias("ts"), F.posexplode(pairs).alias("pos", "x"))
    return d.select(*by, "ts", F.col("x.value").alias("value"), F.create_map(F.lit("field"), F.col("x.field")).alias("labels"), F.col("pos").cast("bigint").alias("seq"))


def merge_candles(hist: DataFrame, live: DataFrame, by: list[str], now: int, step: int) -> DataFrame:
    """Closed buckets from history, else from live; the open bucket from live only."""
    closed = F.col("t") + step <= now
    past = hist.where(closed)
    return past.unionByName(live.join(past, [*by, "t"], "left_anti").select(*past.columns))


def last_closed(df: DataFrame, by: list[str], now: int, step: int) -> DataFrame:
    row = F.struct(*[c for c in df.columns if c not in by])
    return df.where(F.col("t") + step <= now).groupBy(*by).agg(F.max_by(row, "t").alias("x")).select(*by, "x.*")


def body(df: DataFrame) -> DataFrame:
    return df.withColumn("body_high", F.greatest("o", "c")).withColumn("body_low", F.least("o", "c"))


def calendar_next(ts: Column, kind: str, step: int) -> Column:
    """Start of the next bar: crypto adds a step; forex skips to Monday 00:00 UTC; stock trades 9:00-15:00 at UTC+7."""
    after = ts + step
    if kind == "crypto":
        return after
    if kind == "forex":
        day = F.pmod(F.floor(after / 86_400) + 3, F.lit(7))  # Monday is 0
        monday = (F.floor(after / 86_400) + (7 - day)) * 86_400
        return F.when(day >= 5, monday).otherwise(after).cast("bigint")
    local = after + 7 * 3600
    day, second = F.floor(local / 86_400), F.pmod(local, F.lit(86_400))
    opening = F.when(second >= 15 * 3600, day + 1).otherwise(day)
    weekday = F.pmod(opening + 3, F.lit(7))
    opening = F.when(weekday >= 5, opening + (7 - weekday)).otherwise(opening)
    keep = (opening == day) & (second >= 9 * 3600) & (second < 15 * 3600)
    return F.when(keep, after).otherwise(opening * 86_400 + 9 * 3600 - 7 * 3600).cast("bigint")


def trading_sessions(df: DataFrame, by: list[str], kind: str, step: int) -> DataFrame:
    """The bars that a calendar expects between each key's first and last candle, and whether they exist."""
    ends = df.groupBy(*by).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    spine = ends.select(*by, F.explode(F.sequence("lo", "hi", F.lit(step).cast("bigint"))).alias("t"))
    open_ = calendar_next(F.col("t") - step, kind, step) == F.col("t")
    have = df.select(*by, "t").distinct().withColumn("present", F.lit(True))
    return spine.where(open_).join(have, [*by, "t"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def ohlcv_window(df: DataFrame, by: list[str], window: int) -> DataFrame:
    """The last ``window`` closes, highs, lows and previous closes at each bar, padded with the first value."""
    d = with_row_halo(df.withColumn("__zero", F.lit(0)), by, window, ts="t", seq="__zero")
    order = Window.partitionBy(*by, "slice").orderBy("idx")
    frame = order.rowsBetween(-(window - 1), 0)
    d = d.withColumn("pc", F.coalesce(F.lag("c").over(order), F.col("c")))
    for name, source in (("closes", "c"), ("highs", "h"), ("lows", "l"), ("prev_closes", "pc")):
        got = F.collect_list(source).over(frame)
        d = d.withColumn(name, F.concat(F.array_repeat(F.element_at(got, 1), F.lit(window) - F.size(got)), got))
    return d.where("own").drop("pc", "idx", "slice", "own", "__zero")


def station_candles(df: DataFrame, lo: int, hi: int, by: list[str], resolution: str | None = None, *, block_secs: int | None = None) -> DataFrame:
    """Candles of a station's observations in [lo, hi]; negative bounds count as 0."""
    from tidemark.operators.query import query_recent

    return candles_from_observations(query_recent(df, max(0, lo), max(0, hi), block_secs=block_secs), by, resolution)
