"""Technical indicators over keyed candles (by..., t, o, h, l, c, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.sliced import with_row_halo


def order(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("t")


def _tail(by: list[str], n: int) -> WindowSpec:
    return order(by).rowsBetween(-(n - 1), 0)


def roc(x: Column, by: list[str], period: int) -> Column:
    before = F.lag(x, period).over(order(by))
    return F.when(before != 0, (x - before) / before)


def ma(x: Column, by: list[str], period: int) -> Column:
    return F.avg(x).over(_tail(by, period))


def _weighted(x: Column, by: list[str], window: int, k: float) -> Column:
    """Sum of k (1 - k)^age over the last ``window`` values, not renormalised."""
    values = F.reverse(F.collect_list(x).over(_tail(by, window)))
    terms = F.transform(values, lambda v, age: v * k * F.pow(F.lit(1 - k), age))
    return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)


def ema(x: Column, by: list[str], period: int, window: int) -> Column:
    return _weighted(x, by, window, 2 / (period + 1))


def with_rsi(df: DataFrame, by: list[str], column: str, period: int, window: int, name: str = "rsi") -> DataFrame:
    """Weighted gains over gains and losses, between 0 and 1 (0.5 without movement)."""
    d = df.withColumn("__d", F.col(column) - F.lag(column).over(order(by)))
    up, down = F.greatest(F.coalesce("__d", F.lit(0.0)), F.lit(0.0)), F.greatest(-F.coalesce(F.col("__d"), F.lit(0.0)), F.lit(0.0))
    g, loss = _weighted(up, by, window, 1 / period), _weighted(down, by, window, 1 / period)
    d = d.withColumn("__g", g).withColumn("__l", loss)
    return d.withColumn(name, F.when(F.col("__g") + F.col("__l") > 0, F.col("__g") / (F.col("__g") + F.col("__l"))).otherwise(0.5)).drop("__d", "__g", "__l")


def with_atr(df: DataFrame, by: list[str], period: int, window: int, name: str = "atr") -> DataFrame:
    """Weighted true range: the largest of h - l and the distances of h and l to the previous close."""
    pc = F.lag("c").over(order(by))
    d = df.withColumn("__tr", F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - pc), F.abs(F.col("l") - pc)))
    return d.withColumn(name, _weighted(F.col("__tr"), by, window, 2 / (period + 1))).drop("__tr")


def donchian_high(by: list[str], period: int) -> Column:
    return F.max("h").over(_tail(by, period))


def donchian_low(by: list[str], period: int) -> Column:
    return F.min("l").over(_tail(by, period))


BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b,
    "div": lambda a, b: F.when(b != 0, a / b), "max": F.greatest, "min": F.least,
}
UNARY = {"abs": F.abs, "neg": lambda x: -x, "sigmoid": lambda x: 1 / (1 + F.exp(-x))}


def head(features: list[str], matrix: list[list[float]], bias: list[float] | None = None) -> list[Column]:
    """A linear layer: one column for each output row of ``matrix``."""
    bias = bias or [0.0] * len(matrix)
    return [sum((F.col(f) * w for f, w in zip(features, row, strict=True)), F.lit(float(b))) for row, b in zip(matrix, bias, strict=True)]


def feature_graph(df: DataFrame, by: list[str], nodes: dict[str, tuple]) -> DataFrame:
    """Adds the nodes of a graph {name: (operator, inputs or parameters...)} as columns, in order of dependence.

    Operators: roc, ma, ema, rsi, atr, donchian_high, donchian_low, last, concat (an array of its inputs), and the binary and unary
    ones; inputs are raw columns or other nodes.  Keys are cut into slices of rows with a halo as long as all
    look-backs together, so no key is one window.
    """
    back = sum(max((x for x in spec[1:] if isinstance(x, int)), default=0) + 1 for spec in nodes.values())
    names, keys = df.columns, by
    df = with_row_halo(df.withColumn("__zero", F.lit(0)), by, back, ts="t", seq="__zero")
    by = [*by, "slice"]
    left = dict(nodes)
    while left:
        ready = [n for n, spec in left.items() if not any(x in left for x in spec[1:] if isinstance(x, str))]
        if not ready:
            raise ValueError(f"nodes depend on each other: {sorted(left)}")
        for name in ready:
            op, *args = left.pop(name)
            if op in BINARY:
                df = df.withColumn(name, BINARY[op](F.col(args[0]), F.col(args[1])))
            elif op in UNARY:
                df = df.withColumn(name, UNARY[op](F.col(args[0])))
            elif op == "rsi":
                df = with_rsi(df, by, args[0], args[1], args[2], name)
            elif op == "atr":
                df = with_atr(df, by, args[0], args[1], name)
            elif op in ("donchian_high", "donchian_low"):
                df = df.withColumn(name, (donchian_high if op == "donchian_high" else donchian_low)(by, args[0]))
            elif op == "ema":
                df = df.withColumn(name, ema(F.col(args[0]), by, args[1], args[2]))
            elif op in ("roc", "ma"):
                df = df.withColumn(name, (roc if op == "roc" else ma)(F.col(args[0]), by, args[1]))
            elif op == "last":
                df = df.withColumn(name, F.col(args[0]))
            elif op == "concat":
                df = df.withColumn(name, F.array(*[F.col(a) for a in args]))
            else:
                raise ValueError(f"unknown operator {op!r}")
    return df.where("own").select(*names, *[n for n in nodes if n not in names and n not in keys])


def sliced_nodes(df: DataFrame, by: list[str], back: int, add) -> DataFrame:
    """``add(rows, keys)`` applied to slices of rows with ``back`` rows of halo: the other functions here on keys of any length."""
    d = add(with_row_halo(df.withColumn("__zero", F.lit(0)), by, back, ts="t", seq="__zero"), [*by, "slice"])
    return d.where("own").drop("idx", "slice", "own", "__zero")


def plan_from_predictions(df: DataFrame, by: list[str], *, n_levels: int, width_atr: float, bias: str, win_p: str, realised: DataFrame | None = None) -> DataFrame:
    """A price grid of ``width_atr`` ATRs around each last close; win probability clamped, blended with realised rates."""
    last = df.groupBy(*by).agg(F.max_by(F.struct("c", "atr", F.col(bias).alias("bias"), F.col(win_p).alias("p")), "t").alias("x")).select(*by, "x.*")
    half = F.col("atr") * width_atr
    p = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("p")))
    if realised is not None:
        last = last.join(realised.select(*by, "wins", "losses"), by, "left")
        n = F.coalesce(F.col("wins") + F.col("losses"), F.lit(0))
        p = F.when(n >= 5, 0.8 * p + 0.2 * F.col("wins") / n).otherwise(p)
    levels = F.transform(F.sequence(F.lit(0), F.lit(n_levels - 1)), lambda i: F.col("c") - half + 2 * half * i / max(1, n_levels - 1))
    return last.select(*by, levels.alias("levels"), F.signum("bias").alias("direction"), F.least(F.lit(1.0), F.abs("bias")).alias("strength"), p.alias("win_p"))
