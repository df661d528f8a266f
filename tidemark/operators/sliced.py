"""Ordered operators that don't put one key's whole history into one task.

Keys of up to ``ROWS`` rows are one window each.  Where a key has more, series are cut into slices of a bounded number of
rows, whatever their density: the bits of (ts, seq) are looked at from the top, and only cells that hold
too many rows are looked at more closely - within an hour, within a second, within equal seconds by ``seq``.
Windows run inside (key, slice); what crosses a slice border - the previous row, a running total, the rows of a
trailing window - is added from one small row per slice or from a halo of copied rows.

Only rows that agree in key, ts and seq are never parted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize

#: Rows of one key that one window may hold; slices hold at most three times as many.
ROWS = 1_000_000
#: Bits of ts or seq that one look resolves.
LOOK_BITS = 10


def largest(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest key: one partially aggregated count."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def fits(df: DataFrame, by: list[str], rows: int | None = None) -> bool:
    """Whether no key has more than ``rows`` rows."""
    return largest(df, by) <= (rows or ROWS)


def frames_fit(df: DataFrame, by: list[str]) -> bool:
    """Whether keys are so small that frames of time may be added up anew for every row; beyond that, `spans` does it."""
    return fits(df, by, max(1, ROWS // 50))


def joined(df: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of ``table``, which has one row for each key; null keys meet each other."""
    right = table.select(*[F.col(b).alias(f"__k_{b}") for b in by], *[c for c in table.columns if c not in by])
    if not by:
        return df.crossJoin(F.broadcast(right))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__k_{b}"))
    return df.join(right, same).drop(*[f"__k_{b}" for b in by])


def _shifts(low: int | None, high: int | None) -> list[int]:
    """How far to shift a number of this range for each look, from coarse to exact."""
    width = (int(low or 0) ^ int(high or 0)).bit_length()
    return [*range(max(0, width - LOOK_BITS), 0, -LOOK_BITS), 0]


def with_slices(df: DataFrame, by: list[str], *, ts: str = "ts", seq: str = "seq", rows: int | None = None) -> DataFrame:
    """Adds ``__slice``: an array that rises with (ts, seq) inside a key and is shared by at most 3 ``rows`` rows.

    Each look counts the cells of those that were too large before it; cells in a row are put together up to ``rows`` rows.
    """
    rows = rows or ROWS
    at, tie = F.col(ts).cast("bigint"), F.col(seq).cast("bigint")
    ends = df.agg(F.min(at), F.max(at), F.min(tie), F.max(tie)).first()
    looks = [([F.shiftright(at, b)], b) for b in _shifts(ends[0], ends[1])] + [([at, F.shiftright(tie, b)], b) for b in _shifts(ends[2], ends[3])]
    tables, heavy, parent = [], None, []
    for level, (cells, _) in enumerate(looks):
        own = [f"__c{level}_{i}" for i in range(len(cells))]
        d = df.select(*by, *[c.alias(n) for n, c in zip(own, cells, strict=True)], *[c.alias(n) for n, c in parent])
        if heavy is not None:
            d = d.join(heavy, [*by, *[n for n, _ in parent]], "left_semi")
        held = [n for n, _ in parent]
        counts = d.groupBy(*by, *held, *own).agg(F.count(F.lit(1)).alias("__n"))
        before = Window.partitionBy(*by, *held).orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** LOOK_BITS cells
        counts = counts.withColumn("__g", F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / rows).cast("bigint"))
        counts = materialize(counts.drop(*held), "slices")
        tables.append((own, cells, counts.select(*by, *own, F.col("__g").alias(f"__g{level}"))))
        heavy = counts.where(F.col("__n") > rows).select(*by, *own)
        parent = list(zip(own, cells, strict=True))
        if heavy.isEmpty():
            break
    d = df
    for own, cells, table in tables:
        d = d.withColumns(dict(zip(own, cells, strict=True))).join(table, [*by, *own], "left")
    path = F.array(*[F.coalesce(f"__g{i}", F.lit(0).cast("bigint")) for i in range(len(tables))])
    return d.withColumn("__slice", path).select(*df.columns, "__slice")


def with_lag(
    df: DataFrame, by: list[str], columns: dict[str, str], *, ts: str = "ts", seq: str = "seq", rows: int | None = None, whole: bool | None = None
) -> DataFrame:
    """Adds ``columns`` {new name: source column} of the previous row of the key by (ts, seq)."""
    values = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    if fits(df, by, rows) if whole is None else whole:
        d = df.withColumn("__prev", F.lag(values).over(Window.partitionBy(*by).orderBy(ts, seq)))
        return d.select(*df.columns, *[F.col("__prev")[n].alias(n) for n in columns])
    d = with_slices(df, by, ts=ts, seq=seq, rows=rows)
    inside = Window.partitionBy(*by, "__slice").orderBy(ts, seq)
    over = Window.partitionBy(*by).orderBy("__slice")  # one row for each slice
    edges = d.groupBy(*by, "__slice").agg(F.max_by(values, F.struct(ts, seq)).alias("__last"))
    edges = edges.withColumn("__carry", F.lag("__last").over(over)).drop("__last")
    d = d.withColumn("__prev", F.lag(values).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    d = d.join(edges, [*by, "__slice"])
    prev = F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__prev"))
    d = d.withColumn("__prev", prev)
    return d.select(*df.columns, *[F.col("__prev")[n].alias(n) for n in columns])


def _with_upto(df: DataFrame, by: list[str], terms: dict[str, Column], fn, *, ts: str, seq: str, rows: int | None, whole: bool | None, ties: list[str] | None = None) -> DataFrame:
    """Adds ``fn`` of each term over the rows of the key up to and including each row by (ts, seq)."""
    d = df.withColumns({f"__{n}": e for n, e in terms.items()})
    upto = lambda *keys: Window.partitionBy(*keys).orderBy(ts, seq, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    if fits(df, by, rows) if whole is None else whole:
        return d.withColumns({n: fn(f"__{n}").over(upto(*by)) for n in terms}).select(*df.columns, *terms)
    d = with_slices(d, by, ts=ts, seq=seq, rows=rows)
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    edges = d.groupBy(*by, "__slice").agg(*[fn(f"__{n}").alias(f"__t_{n}") for n in terms])
    edges = edges.select(*by, "__slice", *[fn(f"__t_{n}").over(before).alias(f"__o_{n}") for n in terms])
    d = d.withColumns({f"__i_{n}": fn(f"__{n}").over(upto(*by, "__slice")) for n in terms}).join(edges, [*by, "__slice"])
    both = lambda n: F.array_compact(F.array(f"__o_{n}", f"__i_{n}"))
    fold = (lambda n: F.array_max(both(n))) if fn is F.max else (lambda n: F.coalesce(F.col(f"__o_{n}") + F.col(f"__i_{n}"), f"__i_{n}", f"__o_{n}"))
    return d.select(*df.columns, *[fold(n).alias(n) for n in terms])


def with_running(
    df: DataFrame, by: list[str], sums: dict[str, Column], *, ts: str = "ts", seq: str = "seq", rows: int | None = None, whole: bool | None = None,
    ties: list[str] | None = None,
) -> DataFrame:
    """Adds running sums {name: expression} up to and including each row of the key by (ts, seq, ties...); 0 where all are null."""
    d = _with_upto(df, by, sums, F.sum, ts=ts, seq=seq, rows=rows, whole=whole, ties=ties)
    return d.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in sums})


def with_running_max(
    df: DataFrame, by: list[str], terms: dict[str, Column], *, ts: str = "ts", seq: str = "seq", rows: int | None = None, whole: bool | None = None
) -> DataFrame:
    """Adds running maxima {name: expression} up to and including each row of the key by (ts, seq)."""
    return _with_upto(df, by, terms, F.max, ts=ts, seq=seq, rows=rows, whole=whole)


def with_halo(df: DataFrame, back: int, fore: int = 0, *, ts: str = "ts") -> DataFrame:
    """Each row in its own time slice (``own``) and, as a copy, in the slices that look back (or ahead) to it.

    For tables of at most one row for each second of a key: a slice holds so many seconds, and no more rows.
    """
    secs = max(86_400, 8 * (back + fore))
    first, last = F.floor((F.col(ts) - fore) / secs).cast("bigint"), F.floor((F.col(ts) + back) / secs).cast("bigint")
    d = df.withColumn("slice", F.explode(F.sequence(first, last)))
    return d.withColumn("own", F.col("slice") == F.floor(F.col(ts) / secs))


def with_index(
    df: DataFrame, by: list[str], name: str = "idx", *, ts: str = "ts", seq: str = "seq", rows: int | None = None, whole: bool | None = None
) -> DataFrame:
    """Adds the row's place in its key by (ts, seq), from 0."""
    d = with_running(df, by, {name: F.lit(1).cast("bigint")}, ts=ts, seq=seq, rows=rows, whole=whole)
    return d.withColumn(name, (F.col(name) - 1).cast("bigint"))


def with_row_halo(
    df: DataFrame, by: list[str], back: int, fore: int = 0, *, ts: str = "ts", seq: str = "seq", rows: int | None = None, whole: bool | None = None
) -> DataFrame:
    """Adds ``idx``, ``slice`` and ``own``: slices of rows of equal size, each with copies of ``back`` rows before it and ``fore`` rows after it.

    Windows of rows over (by..., slice) ordered by ``idx`` are exact for the rows that a slice owns.  Unless ``rows`` says how long slices are to be,
    keys of up to ``ROWS`` rows are one slice.
    """
    whole = fits(df, by) if whole is None else whole
    d = df if "idx" in df.columns else with_index(df, by, ts=ts, seq=seq, whole=whole)
    if whole and rows is None:
        return d.withColumn("slice", F.lit(0).cast("bigint")).withColumn("own", F.lit(True))
    size = max(rows or 16_384, 8 * (back + fore))
    first, last = F.floor((F.col("idx") - fore) / size), F.floor((F.col("idx") + back) / size)
    d = d.withColumn("slice", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return d.withColumn("own", F.col("slice") == F.floor(F.col("idx") / size))


def lags(df: DataFrame, by: list[str], columns: dict[str, tuple[str | Column, int]], *, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Adds {name: (column, k)}: the value k rows before (after, if k is negative) in the key by (ts, seq)."""
    ks = [k for _, k in columns.values()] or [0]
    d = with_row_halo(df, by, max(0, *ks) if len(ks) > 1 else max(0, ks[0]), max(0, -min(ks)), ts=ts, seq=seq)
    w = Window.partitionBy(*by, "slice").orderBy("idx")
    d = d.withColumns({n: F.lag(c, k).over(w) for n, (c, k) in columns.items()})
    return d.where("own").select(*df.columns, *columns)
