"""Order-ledger analytics: de-duplication, P&L, reports, levels and barriers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import barriers
from tidemark.operators import grid as G
from tidemark.operators.query import MAX_WINDOW, check_query_bounds, order_and_limit, query_recent, window_fits_cap
from tidemark.operators.sliced import fits, with_lag, with_running, with_running_max
from tidemark.operators.timeseries import bucket_align, gap_fill, parse_resolution
from tidemark.sources.scratch import materialize

FEE_ROUNDTRIP = 0.0004


def ledger_fields() -> list[Column]:
    """The typed columns of an order row of observations."""
    def num(k: str, kind: str = "double") -> Column:
        return F.expr(f"try_cast(labels['{k}'] AS {kind})").alias(k)

    lab = F.col("labels")
    return [
        F.col("ts"), *[lab[k].alias(k) for k in ("order_id", "status", "dtype")], num("grid", "int"), num("level", "int"), num("size"), F.col("value").alias("entry"),
        num("sl"), num("tp"), num("unlock_seq", "bigint"), num("pnl_pct"), num("exit_price"), F.col("seq"),
    ]


def ledger_from_observations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed order rows of observations with signal ``order``, and the rows that lack a side or a price."""
    d = df.where(F.col("signal") == "order").select(*ledger_fields())
    good = F.coalesce(F.col("dtype").isin("long", "short") & (F.col("entry") > 0), F.lit(False))
    return d.where(good), d.where(~good)


def dedup_orders(df: DataFrame, ties: list[str]) -> DataFrame:
    """The latest row of each order id (ties: the greatest of ``ties``); rows without an id all stay."""
    row = F.struct(*df.columns)
    latest = df.where("order_id IS NOT NULL").groupBy("order_id").agg(F.max_by(row, F.struct("ts", *ties)).alias("x")).select("x.*")
    return latest.unionByName(df.where("order_id IS NULL"))


def _settled(df: DataFrame) -> DataFrame:
    """Closed and open rows; a missing size or result counts as 0."""
    d = df.where(F.col("status").isin("closed", "open"))
    return d.withColumns({"size": F.coalesce("size", F.lit(0.0)), "pnl_pct": F.coalesce("pnl_pct", F.lit(0.0))})


def _aggregates() -> list[Column]:
    """Results in percent are per trade, money is size times percent; losing trades have results of at most 0, so gross loss isn't positive."""
    closed, held = F.col("status") == "closed", (F.col("status") == "open") & (F.col("size") > 0)
    won, lost = closed & (F.col("pnl_pct") > 0), closed & (F.col("pnl_pct") <= 0)
    money = F.col("size") * F.col("pnl_pct")

    def total(cond: Column, x: Column | str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(x) if isinstance(x, str) else x)), F.lit(0.0))

    return [
        F.count_if(closed).alias("trades"), F.count_if(won).alias("wins"), F.count_if(lost).alias("losses"),
        F.count_if(closed & (F.col("dtype") == "long")).alias("longs"), F.count_if(closed & (F.col("dtype") == "short")).alias("shorts"),
        total(closed, money).alias("net_pnl_abs"), total(won, money).alias("gross_profit"), total(lost, money).alias("gross_loss"),
        total(closed, "size").alias("notional"), total(closed, "pnl_pct").alias("pnl_pct_sum"), total(won, "pnl_pct").alias("win_pct_sum"),
        total(lost, "pnl_pct").alias("loss_pct_sum"), F.count_if(held).alias("open_count"), total(held, "size").alias("open_notional"),
        F.count_if(closed & (F.col("size") == 0)).alias("zero_size_rows"),
    ]


def _ratios(d: DataFrame) -> DataFrame:
    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    ratios = {
        "win_rate": ratio("wins", "trades"), "net_pnl_pct": ratio("pnl_pct_sum", "trades"), "avg_win_pct": ratio("win_pct_sum", "wins"), "avg_loss_pct": ratio("loss_pct_sum", "losses")
    }
    return d.withColumns(ratios).drop("pnl_pct_sum", "win_pct_sum", "loss_pct_sum")


def pnl_buckets(df: DataFrame, bucket_secs: int, *, fill: bool = True) -> DataFrame:
    """Trades, wins, profit and open positions per time bucket; missing buckets are zero rows."""
    d = _settled(df).groupBy(bucket_align(F.col("ts"), bucket_secs).alias("bucket")).agg(*_aggregates())
    if fill and bucket_secs:
        d = gap_fill(d, [], "bucket", bucket_secs, [c for c in d.columns if c != "bucket"])
    return _ratios(d)


def pnl_total(df: DataFrame) -> DataFrame:
    """Totals from raw sums (not means of means)."""
    return _ratios(_settled(df).agg(*_aggregates()))


def pnl_rollup(df: DataFrame, bucket_secs: int) -> DataFrame:
    """Buckets and the grand total (null bucket) in one pass."""
    d = _settled(df).withColumn("bucket", bucket_align(F.col("ts"), bucket_secs))
    return _ratios(d.rollup("bucket").agg(*_aggregates()))


def unrealized_pnl(df: DataFrame, mark: float | Column, *, fee: float = FEE_ROUNDTRIP, by: list[str] | None = None) -> DataFrame:
    """Open rows valued at a mark price, by side, less the fee; rows of size or entry 0 are skipped, rows of neither side are worth 0."""
    mark = F.lit(mark) if isinstance(mark, float | int) else mark
    open_ = (F.col("status") == "open") & (F.col("size") != 0) & (F.col("entry") != 0)
    move = (mark - F.col("entry")) / F.col("entry")
    worth = F.when(F.col("dtype") == "long", move - fee).when(F.col("dtype") == "short", -move - fee).otherwise(0.0)
    return df.where(open_).groupBy(*(by or []), "dtype").agg(F.sum(F.col("size") * worth).alias("unrealized"), F.count("*").alias("positions"))


def orders(
    df: DataFrame, *, now: int, lo: int | None = None, hi: int | None = None, status: str | None = None, limit: int = 1000, order: str = "desc",
    interval: str | None = None, mark: float | None = None, block_secs: int = 5,
) -> dict[str, DataFrame]:
    """Orders and step cursors of a station of observations: ``rows``, ``meta`` (scanned, truncated, order, complete) and, with an interval, ``pnl`` and ``unrealized``.

    Each order id is there once, with its latest row; the status filter comes after that and spares cursors.  ``pnl``
    covers the whole window, ``limit`` cuts ``rows`` only; ``complete`` is false where the window has more blocks than the cap.
    """
    hi = now if hi is None else hi
    lo = hi - MAX_WINDOW if lo is None else lo
    check_query_bounds(lo, hi, limit)
    cursor = F.coalesce(F.col("labels")["kind"] == "trading_step", F.lit(False))
    window = query_recent(df, lo, hi, block_secs=block_secs)
    kept = window.where(cursor | (F.col("signal") == "order")).withColumn("order_id", F.col("labels")["order_id"])
    row = F.struct(*kept.columns)
    latest = kept.where("order_id IS NOT NULL").groupBy("order_id").agg(F.max_by(row, F.struct("ts", "seq")).alias("x")).select("x.*")
    d = latest.unionByName(kept.where("order_id IS NULL"))
    if status is not None:
        d = d.where(cursor | (F.col("labels")["status"] == status))
    sizes = d.agg(F.count("*").alias("n"))
    meta = window.agg(F.count("*").alias("scanned")).crossJoin(F.broadcast(sizes)).select(
        "scanned", (F.col("n") > limit).alias("truncated"), F.lit(order).alias("order"), F.lit(window_fits_cap(lo, hi, block_secs)).alias("complete")
    )
    out = {"rows": order_and_limit(d, limit, order).drop("order_id"), "meta": meta}
    if interval is not None:
        typed = ledger_from_observations(d)[0]
        out["pnl"] = pnl_buckets(typed, parse_resolution(interval))
        if mark is not None:
            out["unrealized"] = unrealized_pnl(typed, mark)
    return out


def trade_report(df: DataFrame, by: list[str]) -> DataFrame:
    """Win rate, profit factor, expectancy, Sharpe, Sortino, Calmar, drawdown and streaks of closed trades.

    Deviations are population ones; equity is the running sum of pnl_pct and its peak starts at 0.
    """
    d = df.where("status = 'closed' AND pnl_pct IS NOT NULL")
    loss = F.col("pnl_pct") <= 0
    whole = fits(d, by)
    d = with_running(d, by, {"equity": F.col("pnl_pct"), "won": (~loss).cast("long")}, whole=whole)
    d = with_running_max(d, by, {"peak": F.col("equity")}, whole=whole)
    d = d.withColumn("drawdown", F.greatest(F.lit(0.0), F.col("peak")) - F.col("equity"))
    streaks = d.where(loss).groupBy(*by, "won").agg(F.count("*").alias("streak")).groupBy(*by).agg(F.max("streak").alias("max_losses"))
    money = F.col("size") * F.col("pnl_pct")
    g = d.groupBy(*by).agg(
        F.count("*").alias("total"), F.avg((~loss).cast("double")).alias("win_rate"), F.sum("pnl_pct").alias("net_pct"),
        F.sum(money).alias("net_abs"), F.sum(F.when(~loss, F.col("pnl_pct")).otherwise(0.0)).alias("won_pct"),
        F.sum(F.when(loss, -F.col("pnl_pct")).otherwise(0.0)).alias("lost_pct"),
        F.avg("pnl_pct").alias("expectancy"), F.stddev_pop("pnl_pct").alias("sd"),
        F.sqrt(F.avg(F.when(F.col("pnl_pct") < 0, F.col("pnl_pct") ** 2).otherwise(0.0))).alias("downside"),
        F.max("drawdown").alias("max_drawdown"),
        F.coalesce(F.avg(F.when(~loss, F.col("pnl_pct"))), F.lit(0.0)).alias("avg_win"),
        F.coalesce(-F.avg(F.when(loss, F.col("pnl_pct"))), F.lit(0.0)).alias("avg_loss"),
        F.avg((F.col("dtype") == "long").cast("double")).alias("long_rate"), F.avg((F.col("dtype") == "short").cast("double")).alias("short_rate"),
    ).join(streaks, by, "left")

    def over(a: Column, b: str) -> Column:
        return F.when(F.col(b) > 1e-12, a / F.col(b)).otherwise(0.0)

    root = F.sqrt("total")
    return g.select(
        *by, "total", (F.col("win_rate") * 100).alias("win_rate"), "net_pct", "net_abs",
        F.when(F.col("lost_pct") > 0, F.col("won_pct") / F.col("lost_pct")).otherwise(F.lit(float("inf"))).alias("profit_factor"),
        "expectancy", over(F.col("expectancy") * root, "sd").alias("sharpe"), over(F.col("expectancy") * root, "downside").alias("sortino"),
        over(F.col("net_pct"), "max_drawdown").alias("calmar"), "max_drawdown", F.coalesce("max_losses", F.lit(0)).cast("long").alias("max_losses"),
        "avg_win", "avg_loss", over(F.col("avg_win"), "avg_loss").alias("win_loss_ratio"), "long_rate", "short_rate",
    )


def score(report: DataFrame, by: list[str], kind: str = "sharpe") -> DataFrame:
    value = F.col("sharpe") if kind == "sharpe" else F.col("net_abs")
    return report.select(*by, F.when(F.col("total") > 0, value).otherwise(0.0).alias("score"))


def uniform_levels(lo: Column, hi: Column, n: int) -> Column:
    """``n`` equally spaced prices, ends included."""
    if n < 2:
        return F.array(lo)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i / (n - 1))


def step_levels(lo: Column, hi: Column, step: float) -> Column:
    return F.transform(F.sequence(F.lit(0).cast("long"), F.floor((hi - lo) / step)), lambda i: lo + i * step)


def centred_levels(mid: Column, step: float, n_each: int) -> Column:
    return F.transform(F.sequence(F.lit(-n_each), F.lit(n_each)), lambda i: mid + i * step)


def explicit_levels(prices: list[float]) -> Column:
    """The given prices, sorted, each once."""
    return F.array(*[F.lit(float(p)) for p in sorted(set(prices))])


def weights(n: int, kind: str = "uniform", *, sharpness: float = 1.0, ascending: bool = True, direction: float = 1.0, strength: float = 0.5) -> Column:
    """Normalised weights of ``n`` levels: uniform, normal, linear or trend."""
    i = F.sequence(F.lit(0), F.lit(n - 1))
    mid = (n - 1) / 2

    def raw(x: Column) -> Column:
        x = x.cast("double")
        if kind == "normal":
            return F.exp(-F.lit(sharpness) * ((x - mid) / max(mid, 1)) ** 2)
        if kind == "linear":
            return x + 1 if ascending else F.lit(float(n)) - x
        if kind == "trend":
            at = (x + 1) / n if direction >= 0 else (F.lit(float(n)) - x) / n
            return F.pow(at, F.lit(1 + 4 * min(1.0, max(0.0, strength))))
        return F.lit(1.0)

    values = F.transform(i, raw)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.transform(values, lambda v: v / total)


def level_touch(candles: DataFrame, levels: DataFrame, by: list[str], band: float | None = None) -> DataFrame:
    """Bars and the levels within their low and high: an equi-join on price bands, then the exact test.

    Bands are as wide as a key's bars on average (or ``band``), so bars meet two bands in the mean, whatever their range.
    """
    if band is None:
        wide = candles.groupBy(*by).agg(F.greatest(F.avg(F.col("h") - F.col("l")), F.max(F.abs("h")) * 1e-9, F.lit(1e-12)).alias("__wide"))
    else:
        wide = candles.select(*by).distinct().withColumn("__wide", F.lit(float(band)))
    at = lambda c: F.floor(F.col(c) / F.col("__wide"))
    bars = candles.join(wide, by).withColumn("__band", F.explode(F.sequence(at("l"), at("h")))).drop("__wide")
    marks = levels.join(wide, by).withColumn("__band", at("price")).drop("__wide")
    return bars.join(marks, [*by, "__band"]).where("price BETWEEN l AND h").drop("__band")


def barrier_exit(entries: DataFrame, candles: DataFrame, by: list[str], *, max_bars: int, fee: float = FEE_ROUNDTRIP) -> DataFrame:
    """The first bar from ``unlock_seq`` on that touches stop or target; the stop wins when both are touched.

    A bar that opens beyond a barrier fills at its open; entries that no bar touches stay ``open`` (no bar, fill or result).
    ``max_bars`` bars, or ``barriers.BLOCK_BARS`` if that is more, are searched at a time; an exit may be any number of bars later.
    """
    long = F.col("dtype") == "long"
    entry = [*by, "order_id", "dtype", "entry", "sl", "tp", "unlock_seq"]
    below, above = F.when(long, F.col("sl")).otherwise(F.col("tp")), F.when(long, F.col("tp")).otherwise(F.col("sl"))
    entries, candles = materialize(entries.select(*entry), "entries"), materialize(candles.select(*by, "bar", "o", "h", "l"), "bars")  # looked at several times
    e = entries.where("unlock_seq IS NOT NULL").select(*entry, F.col("unlock_seq").alias("start"), below.cast("double").alias("below"), above.cast("double").alias("above"))
    block = max(max_bars, barriers.BLOCK_BARS)
    hits = barriers.first_touch(e, candles, by, block=block).where("hit IS NOT NULL").select(*entry, "hit")
    bars = candles.withColumn("hit", F.col("bar").cast("bigint"))
    d = hits.join(bars, [*by, "hit"]).select(*entry, "bar", "o", "h", "l")
    stop = F.when(long, F.col("l") <= F.col("sl")).otherwise(F.col("h") >= F.col("sl"))
    worse = F.when(long, F.least("o", "sl")).otherwise(F.greatest("o", "sl"))
    better = F.when(long, F.greatest("o", "tp")).otherwise(F.least("o", "tp"))
    d = d.withColumn("fill", F.when(stop, worse).otherwise(better)).withColumn("reason", F.when(stop, "sl").otherwise("tp"))
    first = d.groupBy(*by, "order_id", "dtype", "entry").agg(F.min_by(F.struct("bar", "fill", "reason"), "bar").alias("x")).select(*by, "order_id", "dtype", "entry", "x.*")
    move = (F.col("fill") - F.col("entry")) / F.col("entry") * F.when(F.col("dtype") == "long", 1.0).otherwise(-1.0)
    closed = first.withColumn("pnl_pct", move - fee)
    hit = closed.drop("dtype", "entry")
    d = entries.select(*by, "order_id", "dtype", "entry").join(hit, [*by, "order_id"], "left")
    return d.withColumn("reason", F.coalesce("reason", F.lit("open"))).select(*by, "order_id", "dtype", "entry", "bar", "fill", "reason", "pnl_pct")


def one_open_per_level(entries: DataFrame, exits: DataFrame, by: list[str], level: str = "level") -> DataFrame:
    """The exits of entries that find their level free: a level is taken from an accepted entry's ``unlock_seq`` to its exit bar.

    Levels of up to ``sliced.ROWS`` entries are walked in one task.  Beyond that every entry points to the first one after its own exit, and the chain from a
    level's first entry is followed by pointer doubling: each round doubles how far pointers reach.
    """
    d = entries.select(*by, level, "order_id", "unlock_seq").join(exits.select(*by, "order_id", "bar"), [*by, "order_id"])
    if not fits(d, [*by, level]):
        return exits.join(_accepted(d, by, level), [*by, "order_id"], "left_semi")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.select(*by, "order_id").schema)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unlock_seq", "order_id"])
        free, keep = -np.inf, []
        for unlock, bar in zip(pdf["unlock_seq"].to_numpy(), pdf["bar"].to_numpy(float), strict=True):
            ok = unlock > free
            keep.append(ok)
            if ok:
                free = np.inf if np.isnan(bar) else bar
        return pdf.loc[keep, [*by, "order_id"]]

    return exits.join(d.groupBy(*by, level).applyInPandas(walk, keys), [*by, "order_id"], "left_semi")


def _accepted(d: DataFrame, by: list[str], level: str) -> DataFrame:
    """by..., order_id of the entries on the chain from each level's first entry."""
    from tidemark.operators.trend import asof_join

    on = [*by, level]
    d = materialize(d.where("unlock_seq IS NOT NULL"), "entries")
    first = d.groupBy(*on).agg(F.min(F.struct("unlock_seq", "order_id")).alias("x")).select(*on, F.col("x.order_id").alias("order_id"))
    starts = d.groupBy(*on, "unlock_seq").agg(F.min("order_id").alias("next")).select(*on, (-F.col("unlock_seq")).cast("bigint").alias("ts"), "next")
    ends = d.where("bar IS NOT NULL").select(*on, "order_id", (-F.col("bar") - 1).cast("bigint").alias("ts"))
    jump = asof_join(ends, starts, on, values=["next"]).select(*on, "order_id", F.col("right_next").alias("next")).where("next IS NOT NULL")
    reached, jump = materialize(first, "reached"), materialize(jump, "jumps")
    while not jump.isEmpty():
        more = reached.join(jump, [*on, "order_id"]).select(*on, F.col("next").alias("order_id"))
        reached = materialize(reached.unionByName(more).distinct(), "reached")
        second = jump.select(*on, F.col("order_id").alias("next"), F.col("next").alias("after"))
        jump = materialize(jump.join(second, [*on, "next"]).select(*on, "order_id", F.col("after").alias("next")), "jumps")
    return reached.select(*by, "order_id")


def kelly_size(win_p: Column, sl_pct: Column, fraction: float, capital: float) -> Column:
    """Kelly stake at odds 1 / stop; 0 outside (0, 1) and never negative."""
    b = 1 / sl_pct
    kelly = (win_p * b - (1 - win_p)) / b
    ok = (win_p > 0) & (win_p < 1) & (sl_pct > 0) & (sl_pct < 1)
    return F.when(ok, F.greatest(F.lit(0.0), kelly) * fraction * capital).otherwise(0.0)


def fixed_fee(rate: float) -> Column:
    """Round trip of a fixed rate."""
    return F.lit(2 * rate)


def derivative_fee(contract_value: Column, rate: float, minimum: float, clearing: float, tax: float) -> Column:
    """Round trip of max(rate x value, minimum) + clearing + tax x value, as a share of the value."""
    one = F.greatest(contract_value * rate, F.lit(float(minimum))) + clearing + contract_value * tax
    return 2 * one / contract_value


# brokers' fees of derivatives: commission rate, least commission, clearing fee, tax rate, contract multiplier.
BROKERS = {
    "vps_standard": (0.0005, 10_000.0, 3_300.0, 0.001, 100_000.0),
    "vps_internal": (0.0003, 10_000.0, 3_300.0, 0.001, 100_000.0),
    "mbs_standard": (0.00045, 0.0, 3_300.0, 0.001, 100_000.0),
    "mbs_prepaid": (0.0003, 0.0, 3_300.0, 0.001, 100_000.0),
    "ssi_standard": (0.0005, 8_000.0, 3_300.0, 0.001, 100_000.0),
}


def broker_fee(price: Column, broker: str) -> Column:
    """Round trip of a broker's fees at a price, as a share of the contract's value."""
    rate, least, clearing, tax, multiplier = BROKERS[broker]
    return derivative_fee(price * multiplier, rate, least, clearing, tax)


def min_profitable_step(price: Column, fee: float) -> Column:
    return 2 * fee * price


def is_step_profitable(step: Column, price: Column, fee: float) -> Column:
    return step > min_profitable_step(price, fee)


def max_levels_for_profit(lo: Column, hi: Column, fee: float) -> Column:
    """Most levels (at least 2) on [lo, hi] whose spacing still pays the round trip at the upper price."""
    step = min_profitable_step(hi, fee)
    return F.greatest(F.lit(2), F.floor((hi - lo) / step) + 1).cast("long")


def breakeven_win_p(risk: Column, reward: Column, fee: float) -> Column:
    return (risk + 2 * fee) / (reward + risk)


def entry_candidates(touches: DataFrame, levels: DataFrame, by: list[str], *, min_rr: float, sl_pct: float, fee: float) -> DataFrame:
    """Side, target and verdict of touched levels: long up to the grid's middle, else short.

    The target is the next level on the winning side whose distance is ``min_rr`` stops; entries whose gain
    is within the round-trip fee, or without target, carry a reason.
    """
    grid = levels.groupBy(*by).agg(F.array_sort(F.collect_set("price")).alias("grid"))
    d = touches.join(grid, by)
    mid = (F.element_at("grid", 1) + F.element_at("grid", -1)) / 2
    d = d.withColumn("side", F.when(F.col("price") <= mid, "long").otherwise("short"))
    reach = F.col("price") * sl_pct * min_rr
    up = F.array_min(F.filter("grid", lambda g: g - F.col("price") >= F.greatest(reach, F.lit(1e-12))))
    down = F.array_max(F.filter("grid", lambda g: F.col("price") - g >= F.greatest(reach, F.lit(1e-12))))
    d = d.withColumn("tp", F.when(F.col("side") == "long", up).otherwise(down))
    gain = F.abs(F.col("tp") - F.col("price")) / F.col("price")
    reason = F.when(F.col("tp").isNull(), "no target").when(gain <= fee, "within fee")
    return d.withColumn("gain", gain).withColumn("reason", reason).drop("grid")


def outcome_counts(df: DataFrame, by: list[str]) -> DataFrame:
    d = df.where("status = 'closed' AND pnl_pct IS NOT NULL")
    return d.groupBy(*by).agg(F.count_if(F.col("pnl_pct") > 0).alias("wins"), F.count_if(F.col("pnl_pct") <= 0).alias("losses"))


def carry_plan_stats(new: DataFrame, old: DataFrame, by: list[str]) -> DataFrame:
    """Each new price band with the counters of the old one that overlaps it most (ties: nearest middle).

    Counters start at 0 where nothing overlaps or the number of levels differs.
    """
    o = old.select(*by, *[F.col(c).alias(f"old_{c}") for c in ("lo", "hi", "levels", "wins", "losses")])
    pairs = new.join(o, by).where("old_lo <= hi AND old_hi >= lo")  # plans of a key are few: one for each of its grids
    overlap = F.least("hi", "old_hi") - F.greatest("lo", "old_lo")
    dist = F.abs((F.col("lo") + F.col("hi")) / 2 - (F.col("old_lo") + F.col("old_hi")) / 2)
    rest = F.struct("old_levels", "old_wins", "old_losses")
    best = pairs.groupBy(*by, "plan").agg(F.max_by(rest, F.struct(overlap, -dist, rest)).alias("x")).select(*by, "plan", "x.*")
    d = new.join(best, [*by, "plan"], "left")
    same = F.col("old_levels") == F.col("levels")
    return d.select(*new.columns, *[F.when(same, F.col(f"old_{c}")).otherwise(0).alias(c) for c in ("wins", "losses")])


def _outcomes(df: DataFrame) -> DataFrame:
    """Closed orders with ``lost``: a negative result; an order without a result isn't a loss."""
    return df.where("status = 'closed'").withColumn("lost", F.coalesce(F.col("pnl_pct") < 0, F.lit(False)))


def risk_governor(
    df: DataFrame, by: list[str], *, now: int, last: int = 20, size_step: float = 0.1, size_floor: float = 0.2, rate_ref: float = 0.5, rate_penalty: float = 0.5,
    soft_streak: int = 3, skip_cap: int = 5, hard_streak: int = 6, pause_secs: int = 3600, model_win: float = 0.5, sl_widen_max: float = 1.5, newest_first: bool = False,
) -> DataFrame:
    """Losing streak and failure rate of the first ``last`` closed orders in the order given (or the newest), and what they ask for.

    risk_scale shrinks the size by streak and by the rate above its reference; apply_skip thins out steps beyond the soft
    streak; paused holds from the hard streak on until the pause after the last loss is over; sl_widen widens stops by how
    far the share of wins of all closed orders lies below the model's.
    """
    d = _outcomes(df)
    up = [F.desc("ts"), F.desc("seq")] if newest_first else [F.asc("ts"), F.asc("seq")]
    few = d.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(*up))).where(F.col("i") <= last)
    streak = F.coalesce(F.min(F.when(~F.col("lost"), F.col("i"))) - 1, F.count("*")).cast("long")
    g = few.groupBy(*by).agg(streak.alias("streak"), F.avg(F.col("lost").cast("double")).alias("fail_rate"))
    whole = d.groupBy(*by).agg(F.avg((~F.col("lost")).cast("double")).alias("real_win"), F.coalesce(F.max(F.when(F.col("lost"), F.col("ts"))), F.lit(0)).alias("last_fail_ts"))
    k, rate = F.col("streak"), F.col("fail_rate")
    scale = F.when(k > 0, 1 - size_step * k).otherwise(1.0) * F.when(rate > rate_ref, 1 - rate_penalty * (rate - rate_ref)).otherwise(1.0)
    skip = F.when(k > soft_streak, F.least(1 + k - soft_streak, F.lit(skip_cap))).otherwise(1)
    deficit = F.greatest(F.lit(0.0), (model_win - F.col("real_win")) / model_win) if model_win > 0 else F.lit(0.0)
    return g.join(whole, by).select(
        *by, "streak", "fail_rate", F.greatest(scale, F.lit(size_floor)).alias("risk_scale"), skip.cast("long").alias("apply_skip"),
        ((k >= hard_streak) & (F.lit(now) - F.col("last_fail_ts") < pause_secs)).alias("paused"),
        F.least(1 + deficit * (sl_widen_max - 1), F.lit(sl_widen_max)).alias("sl_widen"), "last_fail_ts",
    )


def perf_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of wins (closed orders that aren't losses), counts and notional of open orders by side, and the last result."""
    closed, open_ = F.col("status") == "closed", F.col("status") == "open"
    lost = F.coalesce(F.col("pnl_pct") < 0, F.lit(False))

    def held(side: str) -> list[Column]:
        mine = open_ & (F.col("dtype") == side) & F.col("size").isNotNull()
        return [F.coalesce(F.sum(F.when(mine, F.col("size"))), F.lit(0.0)).alias(f"open_{side}"), F.count_if(mine).alias(f"{side}_count")]

    return df.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(closed, (~lost).cast("double"))), F.lit(0.0)).alias("win_rate"), F.count_if(closed).alias("closed"), F.count_if(open_).alias("open"),
        F.coalesce(F.sum(F.when(open_, F.col("size"))), F.lit(0.0)).alias("open_notional"), *held("long"), *held("short"),
        F.coalesce(F.max_by(F.when(closed, F.col("pnl_pct")), F.when(closed & F.col("pnl_pct").isNotNull(), F.struct("ts", "seq"))), F.lit(0.0)).alias("pnl_last"),
    )


def replay_state(df: DataFrame) -> DataFrame:
    """Open orders: the newest opening of each (grid, level), unless its id was ever closed."""
    closed = df.where("status = 'closed' AND order_id IS NOT NULL").select("order_id").distinct()
    row = F.struct(*df.columns)
    newest = df.where("status = 'open'").groupBy("grid", "level").agg(F.max_by(row, F.struct("ts", "seq", "order_id")).alias("x")).select("x.*")
    return newest.join(closed, "order_id", "left_anti").select(*df.columns)


def replay(df: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    """A session rebuilt from its log of observations, all keyed: ``open`` orders, closed ``history``, ``faults``, ``cursor`` maxima and newest ``plan``.

    Plans are rows of kind ``plan`` with a JSON array in the label ``grids``; one that can't be read clears
    older plans and the time of the next review.
    """
    kind = F.col("labels")["kind"]

    def num(k: str) -> Column:
        return F.coalesce(F.expr(f"try_cast(labels['{k}'] AS bigint)"), F.lit(0))

    steps = df.where(kind == "trading_step").select(*by, "ts", "seq", *[num(k).alias(k) for k in ("candle_seq", "next_review", "candle_id")])
    plans = df.where((F.col("signal") == "summary") & (kind == "plan")).select(*by, "ts", "seq", F.col("labels")["grids"].alias("grids"))
    good = F.coalesce(F.size(F.from_json("grids", "array<string>")) >= 0, F.lit(False))
    broken = plans.where(~good).groupBy(*by).agg(F.max("seq").alias("bad"))
    valid = plans.where(good).join(broken, by, "left").where("bad IS NULL OR seq > bad")
    review = F.max(F.when(F.col("bad").isNull() | (F.col("seq") > F.col("bad")), F.col("next_review")))
    cursor = steps.join(broken, by, "left").groupBy(*by).agg(
        F.max("candle_seq").alias("candle_seq"), F.max("ts").alias("candle_ts"), F.coalesce(review, F.lit(0)).alias("next_review"), F.max("candle_id").alias("candle_id")
    )
    keyed = df.where("signal = 'order'").select(*by, F.struct(*df.columns).alias("o"))
    keep = [c for c in by if c not in ("ts", "seq", "value", "labels", "signal")]
    typed = keyed.select(*[F.col(c) for c in keep], "o.ts", "o.value", "o.labels", "o.signal", "o.seq")
    fields = ledger_fields()
    good_order = F.coalesce(F.col("dtype").isin("long", "short") & (F.col("entry") > 0), F.lit(False))
    d = typed.select(*keep, *fields)
    rows, faults = d.where(good_order), d.where(~good_order)
    closed = rows.where("status = 'closed'")
    row = F.struct(*rows.columns)
    newest = rows.where("status IS NULL OR status <> 'closed'").groupBy(*keep, "grid", "level").agg(F.max_by(row, F.struct("ts", "seq")).alias("x")).select("x.*")
    return {
        "open": newest.join(closed.select(*keep, "order_id").distinct(), [*keep, "order_id"], "left_anti").select(*rows.columns), "history": closed, "faults": faults,
        "cursor": cursor, "plan": valid.groupBy(*by).agg(F.max_by("grids", F.struct("ts", "seq")).alias("grids"), F.max("ts").alias("ts")),
    }


def already_processed(markers: DataFrame, ts: int) -> DataFrame:
    return markers.agg(F.coalesce(F.max("ts") >= ts, F.lit(False)).alias("processed"))


def time_split(df: DataFrame, by: list[str], train: float = 0.8) -> DataFrame:
    """Chronological split: rows up to the share ``train`` of a key's time span are training rows.

    Spans are written first: by their size Spark sees whether they may go to the rows instead of a key's rows to one task.
    """
    ends = materialize(df.groupBy(*by).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")), "spans")
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * train
    return df.join(ends, by).withColumn("part", F.when(F.col("ts") <= at, "train").otherwise("test")).drop("lo", "hi")


def plan_from_grid(
    df: DataFrame, by: list[str], fitted: DataFrame, interval_secs: int, *, risk: float, reward: float, fee: float, realised: DataFrame | None = None, min_trades: int = 10
) -> DataFrame:
    """One row per visited cell: price, win probabilities by side, weight and whether the spacing pays.

    Probabilities follow the cell's drift, clamped to [0.25, max(0.75, breakeven)]; ``realised(by..., cell, dtype, wins, losses)``
    replaces that of its side (long or short) after ``min_trades``.  Weights are inverse occupancy, normalised per key; the key's own slope ratio tilts both sides.
    """
    dominant = G.dominant_cells(df, by, fitted, interval_secs)
    drift = G.move_probabilities(G.transitions(dominant, by), by, per_cell=True).select(*by, F.col("from").alias("cell"), (F.col("up") - F.col("down")).alias("drift"))
    occ = G.occupancy(df, by, fitted, interval_secs).groupBy(*by, "cell").agg(F.sum("n").alias("n"))
    tilt = G.efficiency_ratio(df, by).select(*by, F.col("slope_ratio").alias("tilt"))
    d = occ.join(drift, [*by, "cell"], "left").join(tilt, by).join(fitted.select(*by, "step", "offset"), by)
    even = float((risk + 2 * fee) / (reward + risk))
    top = max(0.75, even)

    def clamp(p: Column) -> Column:
        return F.least(F.lit(top), F.greatest(F.lit(0.25), p))

    lean = F.coalesce("drift", F.lit(0.0)) / 2 + F.col("tilt") / 4
    d = d.withColumn("long_p", clamp(0.5 + lean)).withColumn("short_p", clamp(0.5 - lean))
    if realised is not None:
        for side in ("long", "short"):
            real = realised.where(F.col("dtype") == side).select(*by, "cell", (F.col("wins") / (F.col("wins") + F.col("losses"))).alias("real"), (F.col("wins") + F.col("losses")).alias("trades"))
            d = d.join(real, [*by, "cell"], "left")
            d = d.withColumn(f"{side}_p", F.when(F.col("trades") >= min_trades, clamp(F.col("real"))).otherwise(F.col(f"{side}_p"))).drop("real", "trades")
    total = occ.groupBy(*by).agg(F.sum(1 / F.col("n")).alias("inverse"))
    price = F.col("offset") + (F.col("cell") + 0.5) * F.col("step")
    return d.join(total, by).select(
        *by, "cell", price.alias("price"), "long_p", "short_p", (1 / F.col("n") / F.col("inverse")).alias("weight"), is_step_profitable(F.col("step"), price, fee).alias("pays")
    )


#: Parameter sets that a sweep takes: they are sent to the tasks.
MAX_SETS = 100_000


def _result(entry, sign, sl, tp, o, h, low, fee: float):
    """P&L in shares of positions closed by bars (o, h, low): at the stop if it was touched, at the open if that lies beyond."""
    stop = np.where(sign > 0, low <= sl, h >= sl)
    worse, better = np.where(sign > 0, np.minimum(o, sl), np.maximum(o, sl)), np.where(sign > 0, np.maximum(o, tp), np.minimum(o, tp))
    return (np.where(stop, worse, better) - entry) / entry * sign - fee


def param_sweep(
    entries: DataFrame, candles: DataFrame, by: list[str], params: DataFrame, *, max_bars: int, fee: float = FEE_ROUNDTRIP, windows: dict[str, tuple[int, int]] | None = None
) -> DataFrame:
    """Trades and mean result of each (sl_pct, tp_pct) of ``params`` in each window of bars; ``best`` marks the set of greatest mean score.

    Entries meet their block of bars once, whatever the number of sets; only positions that a block leaves open are rows of their own.

    ``windows`` {name: (from, to)} holds entries by ``unlock_seq`` (to is exclusive), for instance train and test by time;
    none: all bars.  ``mean_score`` is the mean over windows, a window without closed trades counts as 0.
    """
    windows = windows or {"all": (-(1 << 62), 1 << 62)}
    sets = [(r.param, float(r.sl_pct), float(r.tp_pct)) for r in params.select("param", "sl_pct", "tp_pct").limit(MAX_SETS + 1).collect()]
    if len(sets) > MAX_SETS:
        raise ValueError(f"more than {MAX_SETS} parameter sets")
    block = max(max_bars, barriers.BLOCK_BARS)
    of = lambda c: F.floor(F.col(c) / block).cast("bigint")
    bars = materialize(candles.select(*by, F.col("bar").cast("bigint").alias("bar"), *[F.col(c).cast("double").alias(c) for c in "ohl"]).withColumn("block", of("bar")), "bars")
    lo = bars.agg(F.min("block")).first()[0] or 0
    spans = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for n, (a, b) in windows.items()])
    e = entries.where("unlock_seq IS NOT NULL").select(*by, "dtype", F.col("entry").cast("double").alias("entry"), F.col("unlock_seq").cast("bigint").alias("unlock"))
    e = e.withColumn("w", F.explode(F.filter(spans, lambda w: (F.col("unlock") >= w["a"]) & (F.col("unlock") < w["b"])))).withColumn("window", F.col("w.window")).drop("w")
    e = e.withColumn("start", F.greatest(F.col("unlock"), F.lit(lo * block))).withColumn("block", of("start"))
    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in e.select(*by).schema)
    names = [*by, "window", "param", "trades", "total", "sign", "entry", "sl", "tp", "start", "below", "above"]

    def sweep(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Sums over the positions that this block closes, for each set and window; a row for each that it leaves open."""
        b, out = b.sort_values("bar"), []
        low, high, first, bar = (b[c].to_numpy(float) for c in ("l", "h", "o", "bar"))
        search = barriers.Extremes(low, high)
        start = np.searchsorted(bar, a["start"].to_numpy(float))
        price, sign = a["entry"].to_numpy(float), np.where(a["dtype"] == "long", 1.0, -1.0)
        for name, sl_pct, tp_pct in sets:
            sl, tp = price * (1 - sign * sl_pct), price * (1 + sign * tp_pct)
            below, above = np.where(sign > 0, sl, tp), np.where(sign > 0, tp, sl)
            at = search.first(start, below, above) if len(b) else np.zeros(len(a), np.int64)
            done = at < len(b)
            i = at[done]
            pnl = _result(price[done], sign[done], sl[done], tp[done], first[i], high[i], low[i], fee)
            for window, g in pd.Series(pnl, a["window"].to_numpy()[done]).groupby(level=0):
                out.append((*key[: len(by)], window, name, len(g), float(g.sum()), *[None] * 7))
            rest = a[~done]
            out += zip(*[rest[k] for k in by], rest["window"], [name] * len(rest), [None] * len(rest), [None] * len(rest), sign[~done], rest["entry"], sl[~done], tp[~done],
                       rest["start"], below[~done], above[~done], strict=True)
        return pd.DataFrame(out, columns=names).astype({"trades": "Int64", "start": "Int64"})

    on = [*by, "block"]
    parts = F.ceil(F.count(F.lit(1)) / barriers.GROUP_POSITIONS).cast("int")
    counts = e.groupBy(*on).agg(parts.alias("parts"))
    here = e.join(counts, on).withColumn("part", F.pmod(F.xxhash64("unlock", "entry", "dtype", "window"), F.col("parts")).cast("int")).drop("parts")
    there = bars.join(counts, on).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    shape = f"{keys}window string, param string, trades bigint, total double, sign double, entry double, sl double, tp double, start bigint, below double, above double"
    swept = materialize(here.groupBy(*on, "part").cogroup(there.groupBy(*on, "part")).applyInPandas(sweep, shape), "swept")
    # What is still open goes on behind its block.
    left = swept.where("trades IS NULL").withColumn("start", (of("start") + 1) * block).drop("trades", "total")
    hits = barriers.first_touch(left, bars, by, block=block)
    met = hits.join(bars.select(*by, F.col("bar").alias("hit"), "o", "h", "l"), [*by, "hit"], "left")

    def fill(batches):
        for pdf in batches:
            pnl = _result(*(pdf[c].to_numpy(float) for c in ("entry", "sign", "sl", "tp", "o", "h", "l")), fee)
            yield pdf[["window", "param"]].assign(trades=pdf["hit"].notna().astype("int64"), total=np.where(pdf["hit"].notna(), pnl, 0.0), open=pdf["hit"].isna().astype("int64"))

    later = met.mapInPandas(fill, "window string, param string, trades bigint, total double, open bigint")
    now = swept.where("trades IS NOT NULL").select("window", "param", "trades", "total", F.lit(0).cast("bigint").alias("open"))
    g = now.unionByName(later).groupBy("param", "window").agg(F.sum("trades").alias("trades"), F.sum("open").alias("open"), F.sum("total").alias("total"))
    g = g.select("param", "window", "trades", "open", F.when(F.col("trades") > 0, F.col("total") / F.col("trades")).otherwise(0.0).alias("score"))
    means = g.groupBy("param").agg((F.sum("score") / len(windows)).alias("mean_score"))
    top = means.agg(F.max_by("param", F.struct("mean_score", "param")).alias("top"))
    return g.join(means, "param").crossJoin(F.broadcast(top)).withColumn("best", F.col("param") == F.col("top")).drop("top")


def loss_runs(df: DataFrame, by: list[str]) -> DataFrame:
    """Runs of consecutive losing trades: those with as many won trades before them, by (ts, seq, order_id)."""
    d = df.where("status = 'closed' AND pnl_pct IS NOT NULL").select(*by, "ts", "seq", "order_id", "pnl_pct")
    d = with_running(d, by, {"run": (F.col("pnl_pct") > 0).cast("long")}, ties=["order_id"])
    return d.where("pnl_pct <= 0").groupBy(*by, "run").agg(F.count("*").alias("length"), F.min("ts").alias("start"))
