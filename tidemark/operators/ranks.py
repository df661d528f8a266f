"""Exact order statistics of keys of any size.

Where all keys have at most ``WHOLE`` rows, their values are sorted in windows.  Else no task ever holds, and no shuffle moves, a
whole key: one pass takes approximate quantiles (bounded, mergeable) on both sides of each target; others count what lies
below them and keep equal values of the few rows between them, of which the exact rank is picked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sliced import largest
from tidemark.sources.scratch import materialize

ACCURACY = 200_000
WHOLE = 1_000_000
#: Above the approximation's error on both sides (1 / ACCURACY each) and the shift between q n and q (n - 1).
MARGIN = 2.5e-5


def linear(q: float) -> Callable[[Column], Column]:
    """Place of a quantile that interpolates between its neighbours."""
    return lambda n: F.lit(q) * (n - 1)


def floored(q: float) -> Callable[[Column], Column]:
    """Place of a quantile that is the value at or below it."""
    return lambda n: F.floor(F.lit(q) * (n - 1))


def upper_median(n: Column) -> Column:
    return F.floor(n / 2)


def order_statistics(
    df: DataFrame, by: list[str], targets: dict[str, tuple[float, Callable[[Column], Column]]], column: str | Column = "value", *, whole: int = WHOLE,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """by..., one double column per target {name: (q, place)}; ``place`` gives the 0-based place from the count, q its share.

    Rows whose value is null don't count; keys without any have no row.  ``also`` {name: aggregate of ``__x``} is added.
    """
    x = F.col(column) if isinstance(column, str) else column
    d = df.select(*by, x.cast("double").alias("__x")).where("__x IS NOT NULL")
    names = list(targets)
    places = [p for _, p in targets.values()]
    if largest(d, by) <= whole:
        r = F.row_number().over(Window.partitionBy(*by).orderBy("__x")) - 1
        w = d.withColumn("__r", r).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        at = [p(F.col("__n")).cast("double") for p in places]
        picks = []
        for i, a in enumerate(at):
            picks += [F.max(F.when(F.col("__r") == F.floor(a), F.col("__x"))).alias(f"__l{i}"), F.max(F.when(F.col("__r") == F.ceil(a), F.col("__x"))).alias(f"__h{i}"), F.max(a - F.floor(a)).alias(f"__p{i}")]
        picks += [c.alias(n) for n, c in (also or {}).items()]
        g = w.groupBy(*by).agg(*picks) if by else w.agg(*picks).where("__l0 IS NOT NULL")
        low, high, part = ((lambda i, c=c: F.col(f"__{c}{i}")) for c in "lhp")
        return g.select(*by, *[F.when(part(i) == 0, low(i)).otherwise(low(i) + (high(i) - low(i)) * part(i)).alias(n) for i, n in enumerate(names)], *(also or {}))
    shares = [q for q, _ in targets.values()]
    ends = [min(1.0, max(0.0, q + side * MARGIN)) for q in shares for side in (-1, 1)]
    g = d.groupBy(*by).agg(F.count("*").alias("__n"), F.percentile_approx("__x", F.array(*[F.lit(e) for e in ends]), ACCURACY).alias("__e"))
    g = materialize(g, "brackets")
    j = d.join(g, by) if by else d.crossJoin(F.broadcast(g))
    # What lies below each bracket is one row of counts a key; only rows inside a bracket, or of small keys, go on (-1: for all targets).
    below = j.groupBy(*by, "__n").agg(*[F.count_if(F.col("__x") < F.col("__e")[2 * i]).alias(f"__b{i}") for i in range(len(names))])
    place = F.array(*[F.struct(F.lit(i).alias("t"), F.col("__x").between(F.col("__e")[2 * i], F.col("__e")[2 * i + 1]).alias("inside")) for i in range(len(names))])
    group = F.when(F.col("__n") <= whole, F.array(F.lit(-1))).otherwise(F.transform(F.filter(place, lambda p: p["inside"]), lambda p: p["t"]))
    counted = j.select(*by, "__x", F.explode(group).alias("__t")).groupBy(*by, "__t", F.col("__x").alias("__v")).agg(F.count("*").alias("__c"))
    up = Window.partitionBy(*by, "__t").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("__upto", F.sum("__c").over(up))
    ranked = ranked.join(below, by) if by else ranked.crossJoin(F.broadcast(below))
    n = F.col("__n")
    at = [p(n).cast("double") for p in places]

    def value_at(i: int, at: Column) -> Column:
        base = F.when(F.col("__t") == -1, F.lit(0)).otherwise(F.col(f"__b{i}"))
        mine = F.col("__t").isin(-1, i)
        return F.max(F.when(mine & (base + F.col("__upto") > at) & (base + F.col("__upto") - F.col("__c") <= at), F.col("__v")))

    picks = []
    for i in range(len(names)):
        picks += [value_at(i, F.floor(at[i])).alias(f"__l{i}"), value_at(i, F.ceil(at[i])).alias(f"__h{i}")]
    found = ranked.groupBy(*by, "__n").agg(*picks)

    def between(i: int) -> Column:
        low, high = F.col(f"__l{i}"), F.col(f"__h{i}")
        part = at[i] - F.floor(at[i])
        value = F.when(part == 0, low).otherwise(low + (high - low) * part)
        return F.when(low.isNull() | high.isNull(), F.raise_error(F.lit("a rank lies outside its bracket"))).otherwise(value)

    found = found.select(*by, *[between(i).alias(name) for i, name in enumerate(names)])
    if also:
        more = d.groupBy(*by).agg(*[c.alias(n) for n, c in also.items()])
        found = found.join(more, by) if by else found.crossJoin(F.broadcast(more))
    return found


def quantiles(df: DataFrame, by: list[str], qs: dict[str, float], column: str | Column = "value", *, also: dict[str, Column] | None = None) -> DataFrame:
    """Linear quantiles {name: q} of each key, and aggregates ``also`` of the values (column ``__x``) in the same pass where keys are small."""
    return order_statistics(df, by, {n: (q, linear(q)) for n, q in qs.items()}, column, also=also)
