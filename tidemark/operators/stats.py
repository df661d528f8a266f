"""Statistics: description, rolling windows, autocorrelation, tests, decomposition, forecasting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.probability import with_share
from tidemark.operators.ranks import quantiles
from tidemark.operators.sliced import fits, frames_fit, joined, lags, with_row_halo, with_slices
from tidemark.operators.spans import by_second
from tidemark.sources.scratch import materialize

PERCENTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def _corrected_skew(n: Column, g1: Column) -> Column:
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def _corrected_kurtosis(n: Column, g2: Column) -> Column:
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def describe(df: DataFrame, by: list[str], column: str = "value") -> DataFrame:
    """Moments (bias-corrected skewness and excess kurtosis), linear percentiles, median absolute deviation, cv."""
    x = F.col(column)
    d = df.where(x.isNotNull()).select(*by, x.cast("double").alias("x"))
    moments = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "g1": F.skewness, "g2": F.kurtosis}
    names = {f"p{round(p * 100):02d}": p for p in PERCENTILES}
    g = materialize(quantiles(d, by, names, "x", also={n: f("__x") for n, f in moments.items()}), "described")  # a row for each key
    mad = quantiles(d.join(g.select(*by, "p50"), by), by, {"mad": 0.5}, F.abs(F.col("x") - F.col("p50")))
    n = F.col("count").cast("double")
    skew, kurt = _corrected_skew(n, F.col("g1")), _corrected_kurtosis(n, F.col("g2"))
    return g.join(mad, by).select(
        *by, "count", "mean", "std", "min", "max", *names, skew.alias("skew"), kurt.alias("kurtosis"), "mad",
        F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).alias("cv"),
    )


def rolling(df: DataFrame, by: list[str], window_secs: int, fns: list[str], *, center: bool = False, q: float = 0.5) -> DataFrame:
    """Duration windows (ts - w, ts], or centred ones; mean, std, min, max, median, quantile (``q``), skew and kurt (bias-corrected), count."""
    back = window_secs // 2 if center else window_secs - 1
    fore = window_secs // 2 if center else 0
    if not frames_fit(df, by):
        return _rolling_by_second(df, by, back, fore, fns, q)
    w = Window.partitionBy(*by).orderBy("ts").rangeBetween(-back, fore)
    n = F.count("value").over(w).cast("double")
    table = {
        "mean": lambda: F.avg("value").over(w), "std": lambda: F.stddev_samp("value").over(w), "min": lambda: F.min("value").over(w), "max": lambda: F.max("value").over(w),
        "count": lambda: F.count("value").over(w), "skew": lambda: _corrected_skew(n, F.skewness("value").over(w)), "kurt": lambda: _corrected_kurtosis(n, F.kurtosis("value").over(w)),
        "median": lambda: F.percentile("value", 0.5).over(w), "quantile": lambda: F.percentile("value", q).over(w),
    }
    return df.withColumns({f"rolling_{f}": table[f]() for f in fns}).select(*df.columns, *[f"rolling_{f}" for f in fns])


def _rolling_by_second(df: DataFrame, by: list[str], back: int, fore: int, fns: list[str], q: float) -> DataFrame:
    """Rolling statistics with one result for each second, at a cost that doesn't follow the number of rows in a window.

    Powers beyond the first are summed around the key's mean.
    """
    ranks = [f for f in fns if f in ("median", "quantile")]
    ends = bool({"min", "max"} & set(fns))
    n = F.when(F.col("__w") > 0, F.col("__w").cast("double"))
    made = {"count": F.col("__w"), "min": F.col("__lo"), "max": F.col("__hi"), **{f: F.col(f"__q{i}") for i, f in enumerate(ranks)}, "mean": F.col("__s1") / n}
    parts = []
    if set(fns) & made.keys():
        d = by_second(df, by, back, fore, powers=int("mean" in fns), extremes=ends, quantiles=[0.5 if f == "median" else q for f in ranks])
        parts.append(d.select(*by, "ts", *[made[f].alias(f"rolling_{f}") for f in fns if f in made]))
    powers = max({"std": 2, "skew": 3, "kurt": 4}.get(f, 0) for f in fns)
    if powers:
        x = joined(df, df.groupBy(*by).agg(F.avg("value").alias("__c")), by).select(*by, "ts", (F.col("value") - F.col("__c")).alias("value"))
        m = F.col("__s1") / n
        # Windows of equal values have no spread, whatever rounding leaves.
        m2 = F.when(F.col("__hi") > F.col("__lo"), F.greatest(F.col("__s2") / n - m * m, F.lit(0.0))).when(F.isnan("__s1"), float("nan")).otherwise(0.0)
        spread = F.when(m2 > 0, m2)
        m3 = F.col("__s3") / n - 3 * m * F.col("__s2") / n + 2 * m**3
        m4 = F.col("__s4") / n - 4 * m * F.col("__s3") / n + 6 * m * m * F.col("__s2") / n - 3 * m**4
        made = {"std": F.when(n > 1, F.sqrt(m2 * n / (n - 1))), "skew": _corrected_skew(n, m3 / spread**1.5), "kurt": _corrected_kurtosis(n, m4 / spread**2 - 3)}
        d = by_second(x, by, back, fore, powers=powers, extremes=True)
        parts.append(d.select(*by, "ts", *[made[f].alias(f"rolling_{f}") for f in fns if f in made]))
    out = df
    for p in parts:
        out = joined(out, p, [*by, "ts"])
    return out.select(*df.columns, *[f"rolling_{f}" for f in fns])


def quantile(df: DataFrame, by: list[str], q: list[float]) -> DataFrame:
    wide = quantiles(df, by, {f"q{i}": x for i, x in enumerate(q)})
    pairs = F.array(*[F.struct(F.lit(float(x)).alias("q"), F.col(f"q{i}").alias("quantile")) for i, x in enumerate(q)])
    return wide.select(*by, F.explode(pairs).alias("x")).select(*by, "x.*")


def acf(df: DataFrame, by: list[str], nlags: int = 40, z: float = 1.959963984540054) -> DataFrame:
    """Autocorrelation at lags 0..min(nlags, n - 1) with Bartlett half-widths."""
    df = df.where("value IS NOT NULL")
    stats = df.groupBy(*by).agg(F.avg("value").alias("m"), F.count("value").alias("n"))
    d = df.select(*by, "ts", "seq", "value").join(stats, by).withColumn("x", F.col("value") - F.col("m"))
    d = lags(d, by, {f"l{k}": ("x", k) for k in range(1, nlags + 1)})
    sums = d.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.col("x") ** 2).alias("s0"), *[F.sum(F.col("x") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, nlags + 1)])
    r = F.array(F.lit(1.0), *[F.coalesce(F.col(f"s{k}") / F.col("s0"), F.lit(0.0)) for k in range(1, nlags + 1)])
    e = sums.select(*by, "n", F.posexplode(r).alias("lag", "acf")).where("lag < n")
    before = Window.partitionBy(*by).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)  # nlags + 1 rows
    cum = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") ** 2)).over(before), F.lit(0.0))
    return e.withColumn("band", F.when(F.col("lag") == 0, 0.0).otherwise(z * F.sqrt((1 + 2 * cum) / F.col("n")))).drop("n")


def _levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations r[0..k]."""
    out, phi = [1.0], np.zeros(0)
    for k in range(1, len(r)):
        top = r[k] - (phi @ r[k - 1 : 0 : -1] if len(phi) else 0.0)
        low = 1.0 - (phi @ r[1:k] if len(phi) else 0.0)
        a = top / low if abs(low) > 1e-12 else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        out.append(a)
    return np.array(out)


def pacf(df: DataFrame, by: list[str], nlags: int = 40) -> DataFrame:
    """Partial autocorrelation (Durbin-Levinson on the few autocorrelations of each key)."""
    found = acf(df, by, nlags)
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in found.select(*by).schema], "lag int, pacf double"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        return pdf[by].assign(lag=pdf["lag"], pacf=_levinson(pdf["acf"].to_numpy()))

    return found.groupBy(*by).applyInPandas(solve, schema)


def _gram(df: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """Normal-equation sums of y on xs and 1 per key, as one array."""
    cols = [F.lit(1.0), *[F.col(x) for x in xs], F.col(y)]
    pairs = [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    return df.groupBy(*by).agg(F.array(*pairs).alias("g"), F.count("*").alias("n"))


def _solve(g: list[float], k: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and inverse Gram matrix; k regressors with the constant."""
    m = np.zeros((k + 1, k + 1))
    m[np.triu_indices(k + 1)] = g
    m = m + np.triu(m, 1).T
    inv = np.linalg.pinv(m[:k, :k])
    beta = inv @ m[:k, k]
    return beta, float(max(m[k, k] - beta @ m[:k, k], 0.0)), inv


# Published finite-sample critical values of the test with a constant: c0 + c1/n + c2/n^2 + c3/n^3.
ADF_CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}


# Published approximation of the statistic's distribution with a constant: ends of its range, and
# polynomials whose normal probability is the p-value, up to the middle and above it.
ADF_RANGE = (-18.83, -1.61, 2.74)
ADF_LOW = (2.1659, 1.4412, 0.038269)
ADF_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)


# Rows of a key whose sums one task makes at a time: a slice is a row of (lags + 3)^2 sums.
ADF_SLICE_ROWS = 65_536


def _adf_p(tau: float) -> float:
    low, middle, high = ADF_RANGE
    if tau <= low or tau >= high:
        return float(tau >= high)
    z = sum(c * tau**i for i, c in enumerate(ADF_LOW if tau <= middle else ADF_HIGH))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf_test(df: DataFrame, by: list[str], max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller statistic with a constant, its p-value and the lag order of least AIC; keys below 10 points are left out.

    ``max_lag`` None: 12 (n / 100)^(1/4) of the longest key, at most half of its points; shorter keys stop at their own bound.
    """
    df = df.where("value IS NOT NULL").select(*by, "ts", "seq", "value")

    def bound(n: int) -> int:
        own = math.ceil(12 * (n / 100) ** 0.25)
        return max(0, min(own, n // 2 - 2))

    if max_lag is None:
        longest = df.groupBy(*by).count().agg(F.max("count").alias("n")).first()["n"] or 0
        max_lag = bound(longest)
    # Keys too short for the longest lag use the rows and lags that they have.
    sizes = df.groupBy(*by).agg(F.count("*").alias("rows"))
    own = F.least(F.lit(max_lag), F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(F.col("rows") / 100, F.lit(0.25))), F.floor(F.col("rows") / 2) - 2))).cast("int")
    d = with_row_halo(df, by, max_lag + 1, rows=ADF_SLICE_ROWS)
    d = d.join(F.broadcast(sizes.where("rows >= 10").select(*by, own.alias("top"))), by)
    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*by).schema)
    names = [*by, "statistic", "p_value", "lags", "n", "critical_1", "critical_5", "critical_10", "stationary"]

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Normal-equation sums of a slice: the step on 1, the level before it and the steps before it."""
        pdf = pdf.sort_values("idx")
        y, top = pdf["value"].to_numpy(float), int(pdf["top"].iat[0])
        step = np.diff(y)
        rows = np.flatnonzero(pdf["own"].to_numpy(bool) & (pdf["idx"].to_numpy() > top))
        g = np.zeros((top + 3, top + 3))
        for i in range(0, len(rows), 4096):
            at = rows[i : i + 4096]
            m = np.stack([np.ones(len(at)), y[at - 1], *[step[at - 1 - k] for k in range(1, top + 1)], step[at - 1]])
            g += m @ m.T
        return pd.DataFrame([(*key[: len(by)], top, len(rows), g.ravel().tolist())], columns=[*by, "top", "n", "g"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, top = int(pdf["n"].sum()), int(pdf["top"].iat[0])
        full = np.sum([np.asarray(g, float) for g in pdf["g"]], axis=0).reshape(top + 3, top + 3)
        best = None
        for p in range(top + 1):
            keep = [*range(2 + p), top + 2]
            sub = full[np.ix_(keep, keep)]
            beta, rss, inv = _solve(list(sub[np.triu_indices(len(keep))]), 2 + p)
            aic = n * math.log(max(rss, 1e-300) / n) + 2 * (2 + p)
            se = math.sqrt(max(rss / max(n - 2 - p, 1) * inv[1, 1], 1e-300))
            if best is None or aic < best[0]:
                best = (aic, beta[1] / se, p)
        crit = [sum(c / n**i for i, c in enumerate(cs)) for cs in ADF_CRITICAL.values()]
        pv = _adf_p(best[1])
        return pd.DataFrame([(*key, best[1], pv, best[2], n, *crit, pv < 0.05)], columns=names)

    parts = d.groupBy(*by, "slice").applyInPandas(sums, f"{keys}top int, n long, g array<double>")
    shape = "statistic double, p_value double, lags int, n long, critical_1 double, critical_5 double, critical_10 double, stationary boolean"
    return parts.groupBy(*by).applyInPandas(run, keys + shape)


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-z / math.sqrt(2))


def _gamma_cdf(x: np.ndarray, shape: float) -> np.ndarray:
    """Regularised lower incomplete gamma, all values at once: series below shape + 1, continued fraction above."""
    x = np.asarray(x, float)
    out = np.zeros(len(x))
    scale = lambda v: np.exp(-v + shape * np.log(v) - math.lgamma(shape))
    low = (x > 0) & (x < shape + 1)
    if low.any():
        v = x[low]
        term = total = np.full(len(v), 1 / shape)
        for k in range(1, 2000):
            term = term * v / (shape + k)
            total = total + term
            if (np.abs(term) <= np.abs(total) * 1e-14).all():
                break
        out[low] = total * scale(v)
    high = x >= shape + 1
    if high.any():
        v = x[high]
        b = v + 1 - shape
        c, d = np.full(len(v), 1e300), 1 / b
        h = d
        for n in range(1, 2000):
            an, b = -n * (n - shape), b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-14).all():
                break
        out[high] = 1 - h * scale(v)
    return out


def _beta_cdf(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, on the side where it converges fast."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    front = np.zeros(len(x))
    inner = (y > 0) & (y < 1)
    log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    front[inner] = np.exp(p[inner] * np.log(y[inner]) + q[inner] * np.log1p(-y[inner]) - log_beta) / p[inner]
    tiny = 1e-300
    c, d = np.ones(len(x)), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 500):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    part = front * h
    return np.where(swap, 1 - part, np.where(x >= 1, 1.0, part))


def _digamma(x: float) -> float:
    shift = 0.0
    while x < 8:
        shift -= 1 / x
        x += 1
    f = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def _trigamma(x: float) -> float:
    shift = 0.0
    while x < 8:
        shift += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return shift + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def _fit_gamma(mean: float, lmean: float) -> tuple[float, float]:
    """Likelihood fit: log(shape) - digamma(shape) = log(mean) - mean of logs, by Newton's steps."""
    s = max(math.log(mean) - lmean, 1e-12)
    a = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(20):
        a = max(a - (math.log(a) - _digamma(a) - s) / (1 / a - _trigamma(a)), 1e-6)
    return a, mean / a


def _fit_beta(mean: float, var: float, lmean: float, l1mean: float) -> tuple[float, float]:
    """Likelihood fit on (0, 1) from the means of log x and log (1 - x), by Newton's steps from the moments."""
    t = max(mean * (1 - mean) / max(var, 1e-12) - 1, 1e-2)
    a, b = max(mean * t, 1e-2), max((1 - mean) * t, 1e-2)
    for _ in range(50):
        whole = _digamma(a + b)
        g = np.array([_digamma(a) - whole - lmean, _digamma(b) - whole - l1mean])
        w = _trigamma(a + b)
        step = np.linalg.solve(np.array([[_trigamma(a) - w, -w], [-w, _trigamma(b) - w]]), g)
        a, b = max(a - step[0], a / 4), max(b - step[1], b / 4)
        if np.abs(step).max() < 1e-10:
            break
    return a, b


def _fit_weibull(logs: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Likelihood fit from counts of logarithms, by Newton's steps on the shape."""
    n, mean = counts.sum(), (logs * counts).sum() / counts.sum()
    var = (counts * (logs - mean) ** 2).sum() / n
    k = max(math.pi / math.sqrt(6 * max(var, 1e-12)), 1e-3)
    top = logs.max()
    for _ in range(60):
        w = counts * np.exp(k * (logs - top))
        s0, s1, s2 = w.sum(), (w * logs).sum(), (w * logs * logs).sum()
        g = s1 / s0 - 1 / k - mean
        step = g / (s2 / s0 - (s1 / s0) ** 2 + 1 / (k * k))
        k = max(k - step, k / 4)
        if abs(step) < 1e-12 * k:
            break
    return k, math.exp(top + math.log((counts * np.exp(k * (logs - top))).sum() / n) / k)


def _cdf(dist: str, x: np.ndarray, a: float, b: float) -> np.ndarray:
    if dist == "norm":
        return _normal_cdf((x - a) / b)
    if dist == "expon":
        return 1 - np.exp(-np.maximum(x - a, 0) / b)
    if dist == "lognorm":
        return _normal_cdf((np.log(np.maximum(x, 1e-300)) - a) / b)
    if dist == "gamma":
        return _gamma_cdf(x / b, a)
    if dist == "beta":
        return _beta_cdf(x, a, b)
    return 1 - np.exp(-((np.maximum(x, 0) / b) ** a))


DISTRIBUTIONS = ("norm", "expon", "gamma", "beta", "weibull", "lognorm")
LOG_BINS = 4_096


def _parameters(d: DataFrame, by: list[str], dist: str) -> DataFrame:
    """by..., n, a, b: likelihood fits from a key's sums; for Weibull from its logarithms in LOG_BINS ranges with their means."""
    low, lx, l1 = F.col("value"), F.log(F.greatest("value", F.lit(1e-300))), F.log(F.greatest(1 - F.col("value"), F.lit(1e-300)))
    sums = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.min(low).alias("low"),
        F.avg(lx).alias("lmean"), F.var_pop(lx).alias("lvar"), F.avg(l1).alias("l1mean"), F.min(lx).alias("l0"), F.max(lx).alias("l9"),
    )
    if dist == "weibull":
        at = F.least(F.lit(LOG_BINS - 1), F.floor((lx - F.col("l0")) / F.greatest(F.col("l9") - F.col("l0"), F.lit(1e-12)) * LOG_BINS))
        bins = d.join(sums.select(*by, "l0", "l9"), by).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("c"), F.avg(lx).alias("l"))
        sums = sums.join(bins.groupBy(*by).agg(F.collect_list(F.struct("l", "c")).alias("logs")), by)
    else:
        sums = sums.withColumn("logs", F.lit(None).cast("array<struct<l:double,c:bigint>>"))
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.select(*by).schema)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if dist == "norm":
                    ab = r.mean, math.sqrt(max(r.var, 1e-300))
                elif dist == "expon":
                    ab = r.low, max(r.mean - r.low, 1e-300)
                elif dist == "lognorm":
                    ab = r.lmean, math.sqrt(max(r.lvar, 1e-300))
                elif dist == "gamma":
                    ab = _fit_gamma(r.mean, r.lmean)
                elif dist == "beta":
                    ab = _fit_beta(r.mean, r.var, r.lmean, r.l1mean)
                else:
                    ab = _fit_weibull(np.array([x["l"] for x in r.logs]), np.array([x["c"] for x in r.logs], float))
                rows.append((*[getattr(r, b) for b in by], r.n, *map(float, ab)))
            yield pd.DataFrame(rows, columns=[*by, "n", "a", "b"])

    return sums.mapInPandas(run, f"{keys + ', ' if keys else ''}n long, a double, b double")


def fit_distribution(df: DataFrame, by: list[str], dist: str = "norm") -> DataFrame:
    """Parameters, Kolmogorov-Smirnov distance, p-value and whether the fit is accepted at 5 %.

    norm (mean, sd), expon (origin, scale), gamma (shape, scale), beta (two shapes; values inside (0, 1) only),
    weibull (shape, scale), lognorm (mean and sd of logarithms); those after expon use positive values only.  Keys
    below three values have no row.
    """
    if dist not in DISTRIBUTIONS:
        raise ValueError(f"unknown distribution {dist!r}")
    cond = {"norm": "", "expon": "", "beta": " AND value > 0 AND value < 1"}.get(dist, " AND value > 0")
    d = df.where("value IS NOT NULL" + cond).select(*by, F.col("value").cast("double").alias("value"))

    @F.pandas_udf("double")
    def cdf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        for (p, q), at in pd.DataFrame({"a": a, "b": b}).groupby(["a", "b"]).indices.items():
            out[at] = _cdf(dist, x.to_numpy()[at], p, q)
        return pd.Series(out)

    fitted = _parameters(d, by, dist).where("n >= 3")
    counted = d.groupBy(*by, "value").agg(F.count("*").alias("n"))
    e = with_share(counted, by).withColumnRenamed("n", "c").join(fitted, by).withColumn("f", cdf("value", "a", "b"))
    gap = F.greatest(F.abs(F.col("upto") / F.col("n") - F.col("f")), F.abs((F.col("upto") - F.col("c")) / F.col("n") - F.col("f")))
    g = e.groupBy(*by, "a", "b", "n").agg(F.max(gap).alias("ks"))
    lam = (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n")) * F.col("ks")
    terms = [2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 12)]
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(terms, F.lit(0.0))))
    return g.withColumn("p_value", F.when(lam < 0.2, 1.0).otherwise(p)).withColumn("fits_well", F.col("p_value") > 0.05)


def seasonal_decompose(df: DataFrame, by: list[str], period: int, model: str = "additive") -> DataFrame:
    """Centred moving-average trend, seasonal means and residuals; keys shorter than two periods are left out."""
    half = period // 2
    d = with_row_halo(df.select(*by, "ts", "seq", "value"), by, half, half)
    w = Window.partitionBy(*by, "slice").orderBy("idx")
    if period % 2:
        trend = F.sum("value").over(w.rowsBetween(-half, half)) / period
    else:
        ends = (F.lag("value", half).over(w) + F.lead("value", half).over(w)) / 2
        trend = (F.sum("value").over(w.rowsBetween(-half + 1, half - 1)) + ends) / period
    d = d.withColumn("trend", trend).where("own").withColumnRenamed("idx", "i").drop("slice", "own")
    sizes = d.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= 2 * period)
    d = d.join(sizes, by)
    d = d.withColumn("trend", F.when((F.col("i") >= half) & (F.col("i") < F.col("n") - half), F.col("trend")))
    mul = model == "multiplicative"
    free = F.col("value") / F.col("trend") if mul else F.col("value") - F.col("trend")
    place = (F.col("i") % period).alias("place")
    means = d.groupBy(*by, place).agg(F.avg(free).alias("m"))
    whole_mean = means.groupBy(*by).agg(F.avg("m").alias("mm"))
    seasonal = means.join(whole_mean, by).select(*by, "place", (F.col("m") / F.col("mm") if mul else F.col("m") - F.col("mm")).alias("seasonal"))
    d = d.withColumn("place", F.col("i") % period).join(seasonal, [*by, "place"])
    rest = F.col("value") / (F.col("trend") * F.col("seasonal")) if mul else F.col("value") - F.col("trend") - F.col("seasonal")
    return d.withColumn("resid", rest).select(*by, "ts", "seq", "value", "trend", "seasonal", "resid")


def _differences(name: str, d: int, back: int) -> list[Column]:
    """The d-th difference at 0..back rows before, from columns name0 (own value), name1 (one row before), ..."""
    return [sum((F.lit(float((-1) ** i * math.comb(d, i))) * F.col(f"{name}{k + i}") for i in range(d + 1)), F.lit(0.0)) for k in range(back + 1)]


def arima(df: DataFrame, by: list[str], order: tuple[int, int, int], *, long_ar: int = 8) -> DataFrame:
    """ARIMA coefficients by two-stage lagged least squares (not exact likelihood), with residual variance and AIC.

    A long autoregression (``long_beta``) gives residuals; the second regression uses p lags of the series and q lags of them.
    All sums are aggregates; only tiny systems are solved in Python.
    """
    p, d, q = order
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)
    back = long_ar + q if q else p
    raw = df.where("value IS NOT NULL").select(*by, "ts", "seq", "value")
    x = lags(raw, by, {f"v{k}": ("value", k) for k in range(1, back + d + 1)}).withColumn("v0", F.col("value"))
    x = x.select(*by, *[c.alias(f"y{k}") for k, c in enumerate(_differences("v", d, back))]).where(f"y{back} IS NOT NULL")

    def solver(k: int):
        def run(batches):
            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    n = int(r.n)
                    if n <= k + 1:
                        continue
                    beta, rss, _ = _solve(list(r.g), k)
                    rows.append((*[getattr(r, b) for b in by], beta.tolist(), rss / n, n * math.log(max(rss, 1e-300) / n) + 2 * k, n))
                yield pd.DataFrame(rows, columns=[*by, "beta", "sigma2", "aic", "n"])

        return run

    schema = f"{keys}, beta array<double>, sigma2 double, aic double, n long"
    regressors = [f"y{k}" for k in range(1, p + 1)]
    if not q:
        return _gram(x, by, "y0", regressors).mapInPandas(solver(1 + p), schema).withColumn("long_beta", F.array().cast("array<double>"))
    own = [f"y{k}" for k in range(1, long_ar + 1)]
    first = _gram(x, by, "y0", own).mapInPandas(solver(long_ar + 1), schema).select(*by, F.col("beta").alias("long_beta"))
    b = F.col("long_beta")
    x = x.join(first, by).withColumns(
        {f"e{j}": F.col(f"y{j}") - sum((b[i] * F.col(f"y{j + i}") for i in range(1, long_ar + 1)), b[0]) for j in range(1, q + 1)}
    )
    regressors += [f"e{k}" for k in range(1, q + 1)]
    return _gram(x, by, "y0", regressors).mapInPandas(solver(1 + p + q), schema).join(first, by)


def _arima_path(values: np.ndarray, order: tuple[int, int, int], beta: np.ndarray, long_beta: np.ndarray, sigma2: float, steps: int) -> list[tuple[float, float]]:
    """Forecast and its standard deviation for each step; ``values``: the newest raw values, oldest first.

    Past shocks are the residuals of the long autoregression, future ones 0; the deviation sums squared psi weights.
    """
    p, d, q = order
    tails = [np.asarray(values, float)]
    for _ in range(d):
        tails.append(np.diff(tails[-1]))
    hist, ends = list(tails[-1]), [t[-1] for t in tails[:-1]]
    long_ar = len(long_beta) - 1
    shocks = [hist[-j] - long_beta[0] - sum(long_beta[i] * hist[-j - i] for i in range(1, long_ar + 1)) for j in range(q, 0, -1)] if q else []
    ar, ma = beta[1 : 1 + p], beta[1 + p : 1 + p + q]
    whole = np.array([1.0])  # (1 - ar) (1 - B)^d as polynomial
    for factor in [np.concatenate(([1.0], -np.asarray(ar, float)))] + [np.array([1.0, -1.0])] * d:
        whole = np.convolve(whole, factor)
    psi, out = [], []
    for h in range(steps):
        nxt = beta[0] + sum(ar[k] * hist[-1 - k] for k in range(p)) + sum(ma[k] * shocks[-1 - k] for k in range(q))
        hist.append(nxt)
        shocks.append(0.0)
        value = nxt
        for level in range(d - 1, -1, -1):
            ends[level] += value
            value = ends[level]
        psi.append((1.0 if h == 0 else ma[h - 1] if h <= q else 0.0) - sum(whole[i] * psi[h - i] for i in range(1, min(h, len(whole) - 1) + 1)))
        out.append((value, math.sqrt(sigma2 * sum(w * w for w in psi))))
    return out


def arima_forecast(df: DataFrame, by: list[str], order: tuple[int, int, int], steps: int, *, long_ar: int = 8) -> DataFrame:
    """Forecast and 95 % band of each key from its newest values; keys too short for the model have no row."""
    p, d, q = order
    model = arima(df, by, order, long_ar=long_ar)
    need = max(p, long_ar + q if q else 1) + d
    newest = _newest(df.where("value IS NOT NULL"), by, need)
    x = model.join(newest, by).select(*by, "beta", "long_beta", "sigma2", "newest")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if len(r.newest) < need:
                    continue
                path = _arima_path(np.array(r.newest, float), order, np.array(r.beta), np.array(r.long_beta), r.sigma2, steps)
                for h, (value, sd) in enumerate(path):
                    half = 1.959963984540054 * sd
                    rows.append((*[getattr(r, b) for b in by], h + 1, value, value - half, value + half))
            yield pd.DataFrame(rows, columns=[*by, "step", "forecast", "low", "high"])

    return x.mapInPandas(run, f"{keys}, step int, forecast double, low double, high double")


def _newest(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The last ``n`` values of each key, oldest first: the newest of each slice, then the newest of those."""
    at = F.struct(F.col("ts"), F.col("seq"), F.col("value"))
    d = df.withColumn("slice", F.lit(0)) if fits(df, by) else with_slices(df, by).withColumnRenamed("__slice", "slice")
    place = F.row_number().over(Window.partitionBy(*by, "slice").orderBy(F.desc("ts"), F.desc("seq")))
    d = d.withColumn("i", place).where(F.col("i") <= n)
    w = Window.partitionBy(*by).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy(*by, "slice").agg(F.count("*").alias("c")).withColumn("newer", F.coalesce(F.sum("c").over(w), F.lit(0)))
    d = d.join(sizes, [*by, "slice"]).where(F.col("i") + F.col("newer") <= n)
    return d.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["value"]).alias("newest"))


def corr_matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """Correlation of all pairs of columns, long form: pearson, spearman (mean ranks) or kendall (tau-b).

    Rows that lack one of the columns don't count.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    d = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    place = {c: f"c{i}" for i, c in enumerate(columns)}
    if method == "kendall":
        from tidemark.operators.concordance import kendall_tau

        out = None
        for a, b in pairs:
            one = kendall_tau(d, place[a], place[b]).select(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col("tau").alias("corr"))
            out = one if out is None else out.unionByName(one)
        return out
    if method == "spearman":
        for c in place.values():
            counted = d.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
            ranks = with_share(counted, []).select(F.col("value").alias(c), (F.col("upto") - (F.col("n") - 1) / 2).alias(f"r{c}"))
            d = d.join(ranks, c)
        d = d.select(*[F.col(f"r{c}").alias(c) for c in place.values()])
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    row = d.agg(*[F.corr(place[a], place[b]).alias(f"{place[a]}_{place[b]}") for a, b in pairs])
    stacked = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{place[a]}_{place[b]}").alias("corr")) for a, b in pairs])
    return row.select(F.explode(stacked).alias("s")).select("s.*")


def histogram(df: DataFrame, by: list[str], bins: int = 50) -> DataFrame:
    """Counts and densities of equal bins between each key's minimum and maximum."""
    ends = df.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    d = df.where("value IS NOT NULL").join(ends, by)
    b = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / width))).otherwise(0).cast("int")
    return d.groupBy(*by, "lo", "hi", "n", b.alias("bin")).agg(F.count("*").alias("count")).select(
        *by, "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "count",
        F.when(width > 0, F.col("count") / (F.col("n") * width)).alias("density"),
    )


def box_data(df: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and the count beyond them."""
    g = quantiles(df, by, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    d = df.join(g, by)
    inside = F.col("value").between(low, high)
    return d.groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.count_if(~inside).alias("outliers"))


def heat_data(df: DataFrame, by: list[str], row: str, col: str) -> DataFrame:
    """Mean value per (row, column) cell, long form."""
    return df.groupBy(*by, row, col).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
