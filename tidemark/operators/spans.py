"""Sums, extremes and quantiles over windows of time, whose cost doesn't follow the number of rows in a window.

Frames of Spark windows are added up anew for every row, so that their cost is rows times rows of a window.  Here slices of a key's time,
with a halo of copied rows, are sorted by Spark and taken one by one in tasks: sums are differences of running sums, extremes
come from tables of doubling spans, quantiles from one sorted list into which rows enter and from which they leave.
All rows of a second have the same window, so there is one result for each second.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sliced import with_halo


def _sums(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of x[lo:hi]; running sums carry extra digits, windows that hold infinities or NaN are added up by themselves."""
    good = np.isfinite(x)
    upto = np.concatenate([[0], np.cumsum(np.where(good, x, 0.0), dtype=np.longdouble)])
    out = (upto[hi] - upto[lo]).astype(float)
    if not good.all():
        bad = np.concatenate([[0], np.cumsum(~good)])
        with np.errstate(invalid="ignore"):
            for i in np.flatnonzero(bad[hi] > bad[lo]):
                out[i] = x[lo[i] : hi[i]].sum()
    return out


def _extremes(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """``pick`` (np.fmin or np.maximum) of x[lo:hi], NaN where that is empty."""
    out, width = np.full(len(lo), np.nan), hi - lo
    span, level = 1, x
    while (width >= span).any():
        at = (width >= span) & (width < 2 * span)
        out[at] = pick(level[lo[at]], level[hi[at] - span])
        if len(level) <= span:
            break
        level = pick(level[:-span], level[span:])
        span *= 2
    return out


def _quantiles(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, qs: list[float]) -> np.ndarray:
    """Interpolated quantiles of x[lo:hi] (NaN is greatest), a row each; lo and hi never fall."""
    out, held, a, b, nans = np.full((len(lo), len(qs)), np.nan), [], 0, 0, 0
    values = x.tolist()
    for i, (start, end) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        for v in values[b:end]:
            if v != v:
                nans += 1
            else:
                insort(held, v)
        b = max(b, end)
        for v in values[a:start]:
            if v != v:
                nans -= 1
            else:
                del held[bisect_left(held, v)]
        a = max(a, start)
        n = len(held) + nans
        for j, q in enumerate(qs if n else []):
            at = (n - 1) * q
            low = int(at)
            left = held[low] if low < len(held) else np.nan
            if low == at:
                out[i, j] = left
                continue
            right = held[low + 1] if low + 1 < len(held) else np.nan
            out[i, j] = left if left == right else (low + 1 - at) * left + (at - low) * right
    return out


def by_second(df: DataFrame, by: list[str], back: int, fore: int = 0, *, powers: int = 1, extremes: bool = False, quantiles: Sequence[float] = ()) -> DataFrame:
    """For each second of a key: ``__w`` (values), ``__s1``.. (sums of powers, as many as asked for), ``__lo``, ``__hi`` and ``__q0``.. of the values in [ts - back, ts + fore].

    ``df`` has columns by..., ts, value.  Null values count nowhere, but their seconds have a row.
    """
    qs = [float(q) for q in quantiles]
    found = [*[f"__s{k}" for k in range(1, powers + 1)], *(["__lo", "__hi"] if extremes else []), *[f"__q{i}" for i in range(len(qs))]]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        seconds = np.unique(pdf["ts"].to_numpy(np.int64)[pdf["own"].to_numpy(bool)])
        held = pdf[pdf["__there"]]
        t, x = held["ts"].to_numpy(np.int64), held["value"].to_numpy(float)
        lo = np.searchsorted(t, seconds - back, "left")
        hi = np.maximum(lo, np.searchsorted(t, seconds + fore, "right"))
        made = [_sums(x**k, lo, hi) for k in range(1, powers + 1)]
        made += [_extremes(x, lo, hi, pick) for pick in ((np.fmin, np.maximum) if extremes else ())]
        made += [*_quantiles(x, lo, hi, qs).T] if qs else []
        columns = {b: pd.Series([v] * len(seconds), dtype=object) for b, v in zip(by, key, strict=False)}
        return pd.DataFrame({**columns, "ts": seconds, "__w": hi - lo, **dict(zip(found, made, strict=True))})

    d = df.select(*by, "ts", F.col("value").cast("double").alias("value"), F.col("value").isNotNull().alias("__there"))
    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*by).schema)
    shape = ", ".join(f"{n} double" for n in found)
    out = with_halo(d, back, max(fore, 0)).groupBy(*by, "slice").applyInPandas(run, f"{keys}ts bigint, __w bigint, {shape}")
    # Arrow hands NaN out as null.
    return out.withColumns({n: F.when(F.col("__w") > 0, F.coalesce(n, F.lit(float("nan")))) for n in found})
