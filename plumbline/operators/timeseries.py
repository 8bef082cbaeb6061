"""Time series as tables (time, value[, series]): windows and aggregates on Spark, k-sized mathematics on the driver.

Windows are partitioned by a series column where one is given; without one a single series is one ordered window, as its
order is its nature. Very many series run side by side.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import special as S
from ..functions.columns import col, normalize, number


def _order(time: str, by: list[str] | None = None) -> WindowSpec:
    return Window.partitionBy(*[col(c) for c in by or []]).orderBy(col(time))


def series(df: DataFrame, time: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., t, v) with neither missing; at least three points are needed by the analyses."""
    return normalize(df).select(*[col(c) for c in by or []], col(time).cast("timestamp").alias("t"), number(value).alias("v")).where("t is not null and v is not null")


def rolling(df: DataFrame, time: str, value: str, window: int = 7, by: list[str] | None = None) -> DataFrame:
    """Centred rolling mean and sample deviation; null unless the window is full of values."""
    w = _order(time, by).rowsBetween(-(window - 1 - (window - 1) // 2), (window - 1) // 2)
    full = F.count(number(value)).over(w) == window
    return normalize(df).withColumns({"rolling_mean": F.when(full, F.avg(number(value)).over(w)), "rolling_std": F.when(full, F.stddev_samp(number(value)).over(w))})


def lag_pairs(df: DataFrame, time: str, value: str, lag: int = 1, by: list[str] | None = None) -> DataFrame:
    rows = normalize(df).where(number(value).isNotNull())
    return rows.select(*[col(c) for c in by or []], col(time).alias("t"), F.lag(number(value), lag).over(_order(time, by)).alias("x"), number(value).alias("y")).where("x is not null")


def lag_correlation(df: DataFrame, time: str, value: str, lags: list[int], by: list[str] | None = None) -> DataFrame:
    """(lag, r, n): Pearson's r of the series and itself some places earlier, all lags in one pass."""
    rows = normalize(df).where(number(value).isNotNull())
    w = _order(time, by)
    wide = rows.select(number(value).alias("y"), *[F.lag(number(value), k).over(w).alias(f"x{k}") for k in lags])
    one = wide.agg(*[e for k in lags for e in (F.try_divide(F.covar_pop(f"x{k}", F.when(F.col(f"x{k}").isNotNull(), F.col("y"))), F.stddev_pop(f"x{k}") * F.stddev_pop(F.when(F.col(f"x{k}").isNotNull(), F.col("y")))).alias(f"r{k}"), F.count(f"x{k}").alias(f"n{k}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"r{k}").alias("r"), F.col(f"n{k}").alias("n")) for k in lags])))


UNITS = {"D": "day", "W": "week", "M": "month", "H": "hour", "Q": "quarter", "Y": "year"}
AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "median": F.median}


def resample(df: DataFrame, time: str, value: str, freq: str = "D", how: str = "mean", by: list[str] | None = None) -> DataFrame:
    """One row per period that has rows. Weeks end on Sunday and carry that day, other periods their first instant."""
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how!r}")
    t = col(time).cast("timestamp")
    period = F.date_trunc(UNITS[freq], t)
    if freq == "W":
        period = F.timestamp_add("DAY", F.lit(6), period)
    return normalize(df).groupBy(*[col(c) for c in by or []], period.alias("period")).agg(AGGREGATES[how](number(value)).alias("value"), F.count(number(value)).alias("n"))


def heatmap(df: DataFrame, time: str, value: str, freq: str = "D", how: str = "mean") -> DataFrame:
    """(row, year, value): ISO week by calendar year of daily values, or month by year of monthly ones, in long form."""
    daily = resample(df, time, value, freq, how)
    row = F.weekofyear("period") if freq == "D" else F.month("period")
    return daily.groupBy(row.cast("long").alias("row"), F.year("period").cast("long").alias("year")).agg(F.avg("value").alias("value"))


def linear_trend(df: DataFrame, time: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares line of the value on the point's place 0, 1, ...: slope, intercept, r squared, n, standard error."""
    s = series(df, time, value, by).withColumn("i", (F.row_number().over(Window.partitionBy(*[col(c) for c in by or []]).orderBy("t", "v")) - 1).cast("double"))
    one = s.groupBy(*[col(c) for c in by or []]).agg(F.regr_slope("v", "i").alias("slope"), F.regr_intercept("v", "i").alias("intercept"), F.regr_r2("v", "i").alias("r2"), F.count("v").alias("n"), F.regr_sxx("v", "i").alias("sxx"), F.regr_syy("v", "i").alias("syy"))
    error = F.sqrt(F.try_divide((1 - F.col("r2")) * F.col("syy"), (F.col("n") - 2) * F.col("sxx")))
    return one.withColumn("stderr", error).drop("sxx", "syy")


def time_trend(df: DataFrame, time: str, value: str) -> DataFrame:
    """Line of the value on elapsed seconds."""
    s = series(df, time, value)
    first = s.agg(F.min("t").alias("t0"))
    seconds = (F.unix_micros("t") - F.unix_micros("t0")) / 1e6
    return s.crossJoin(F.broadcast(first)).agg(F.regr_slope("v", seconds).alias("slope"), F.regr_intercept("v", seconds).alias("intercept"))  # one row


def trend_test(df: DataFrame, time: str, value: str) -> dict:
    r = linear_trend(df, time, value).first()
    t = r.slope / r.stderr if r.stderr else math.inf
    return {"slope": r.slope, "intercept": r.intercept, "r2": r.r2, "p_value": S.t_two_sided(t, r.n - 2) if math.isfinite(t) else 0.0, "stderr": r.stderr, "strength": math.sqrt(max(r.r2 or 0.0, 0.0))}


def mann_kendall_s(df: DataFrame, time: str, value: str) -> DataFrame:
    """One row: S, the sum of signs over all pairs in order, and n.

    Values are replaced by dense ranks; a Fenwick tree over the ranks counts smaller and larger predecessors, n log n in
    one task per series instead of a join of all pairs.
    """
    s = series(df, time, value).select("t", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(["t"], kind="stable")["v"].to_numpy()
        levels, code = np.unique(v, return_inverse=True)
        tree, total = [0] * (len(levels) + 1), 0
        for seen, c in enumerate(code.tolist()):
            below, k = 0, c
            while k > 0:
                below += tree[k]
                k -= k & -k
            upto, k = 0, c + 1
            while k > 0:
                upto += tree[k]
                k -= k & -k
            total += below - (seen - upto)
            k = c + 1
            while k < len(tree):
                tree[k] += 1
                k += k & -k
        return pd.DataFrame({"s": [total], "n": [len(v)]})

    return s.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "s long, n long")


def mann_kendall(df: DataFrame, time: str, value: str, alpha: float = 0.05) -> dict:
    r = mann_kendall_s(df, time, value).first()
    spread = math.sqrt(r.n * (r.n - 1) * (2 * r.n + 5) / 18)
    z = (r.s - np.sign(r.s)) / spread if spread else 0.0
    p = 2 * S.normal_sf(abs(z))
    return {"s": r.s, "z": float(z), "p_value": p, "trend": "no trend" if p >= alpha else "increasing" if z > 0 else "decreasing"}


def missing_timestamps(df: DataFrame, time: str, unit: str = "D") -> DataFrame:
    """Periods between the first and the last one without a row."""
    have = df.select(F.date_trunc(UNITS[unit], col(time).cast("timestamp")).alias("t")).where("t is not null").distinct()
    ends = have.agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a is not null")
    step = F.expr(f"interval 1 {UNITS[unit]}")
    return ends.select(F.explode(F.sequence("a", "b", step)).alias("t")).join(have, "t", "left_anti")


def frequency(df: DataFrame, time: str) -> str | None:
    """The constant distance of neighbouring times as a letter or seconds, months and years by the calendar; None if it varies."""
    t = df.select(F.date_trunc("second", col(time).cast("timestamp")).alias("t")).distinct()
    w = Window.orderBy("t")
    steps = t.select((F.unix_timestamp("t") - F.unix_timestamp(F.lag("t").over(w))).alias("s"), F.round(F.months_between("t", F.lag("t").over(w)), 6).alias("m"))
    r = steps.agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("m").alias("m0"), F.max("m").alias("m1")).first()
    if r.s0 is None:
        return None
    if r.s0 == r.s1:
        return {86400: "D", 3600: "H", 60: "min", 1: "s", 604800: "W"}.get(r.s0, f"{r.s0}s")
    return {1: "M", 3: "Q", 12: "Y"}.get(r.m0) if r.m0 == r.m1 else None


def basic_info(df: DataFrame, time: str, value: str) -> DataFrame:
    return normalize(df).agg(F.count(F.lit(1)).alias("length"), F.min(col(time)).alias("start"), F.max(col(time)).alias("end"), F.count_if(number(value).isNull()).alias("missing"), (100.0 * F.count_if(number(value).isNull()) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("missing_percentage"))


def seasonal_means(df: DataFrame, time: str, value: str, period: int) -> DataFrame:
    """(phase, mean, n): the value by its place in the period."""
    s = series(df, time, value).withColumn("phase", ((F.row_number().over(Window.orderBy("t", "v")) - 1) % period).cast("long"))
    return s.groupBy("phase").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def seasonality_test(df: DataFrame, time: str, value: str, period: int) -> dict:
    from .hypothesis import one_way_anova

    s = series(df, time, value).withColumn("phase", ((F.row_number().over(Window.orderBy("t", "v")) - 1) % period).cast("long"))
    return one_way_anova(s, "v", "phase") | {"period": period}


def decompose(df: DataFrame, time: str, value: str, period: int, model: str = "additive") -> DataFrame:
    """Classical decomposition: centred moving average (2 x m for an even period), centred seasonal means, residual."""
    s = series(df, time, value)
    w = Window.orderBy("t", "v")
    s = s.withColumn("i", F.row_number().over(w) - 1)
    half = period // 2
    frame = w.rowsBetween(-half, half)
    if period % 2:
        trend = F.avg("v").over(frame)
    else:
        inner = w.rowsBetween(-half + 1, half - 1)
        trend = (F.sum("v").over(inner) + (F.lag("v", half).over(w) + F.lead("v", half).over(w)) / 2) / period
    full = F.count("v").over(frame) == 2 * half + 1
    s = s.withColumn("trend", F.when(full, trend)).withColumn("phase", F.col("i") % period)
    rest = F.col("v") - F.col("trend") if model == "additive" else F.try_divide("v", "trend")
    means = s.groupBy("phase").agg(F.avg(rest).alias("raw"))
    centre = F.avg("raw").over(Window.partitionBy(F.lit(0)))
    means = means.select("phase", (F.col("raw") - centre if model == "additive" else F.col("raw") / centre).alias("seasonal"))
    joined = s.join(F.broadcast(means), "phase")  # a row per phase
    residual = F.col("v") - F.col("trend") - F.col("seasonal") if model == "additive" else F.col("v") / F.col("trend") / F.col("seasonal")
    return joined.select("t", "v", "trend", "seasonal", residual.alias("residual"))


def component_strength(parts: DataFrame) -> DataFrame:
    """One row: var(component) / (var(component) + var(rest)) of trend and season, within 0 and 1."""
    share = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.var_samp(c), F.var_samp(c) + F.var_samp(F.col("v") - F.col(c)))))
    return parts.agg(share("trend").alias("trend_strength"), share("seasonal").alias("seasonal_strength"), F.try_divide(F.var_samp("seasonal"), F.var_samp("seasonal") + F.var_samp("residual")).alias("seasonality"), F.stddev_samp("seasonal").alias("amplitude"), (F.max("seasonal") - F.min("seasonal")).alias("seasonal_range"))


def interpret_strength(s: float) -> str:
    return ("very weak", "weak", "moderate", "strong", "very strong")[sum(s >= b for b in (0.2, 0.4, 0.6, 0.8))]


def autocorrelation(df: DataFrame, time: str, value: str, nlags: int) -> DataFrame:
    """(lag, acf) from 0 to nlags: all lagged products in one pass over the ordered series."""
    s = series(df, time, value)
    mean = s.agg(F.avg("v").alias("m"))
    w = Window.orderBy("t", "v")
    d = s.crossJoin(F.broadcast(mean)).select("t", "v", (F.col("v") - F.col("m")).alias("d"))  # one row
    wide = d.select("d", *[F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, nlags + 1)])
    one = wide.agg(F.sum(F.col("d") * F.col("d")).alias("s0"), *[F.sum(F.col("d") * F.col(f"d{k}")).alias(f"s{k}") for k in range(1, nlags + 1)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.try_divide(f"s{k}", "s0").alias("acf")) for k in range(nlags + 1)])))


def partial_autocorrelation(acf: list[float], n: int) -> list[float]:
    """Durbin-Levinson on bias-adjusted autocorrelations."""
    r = [a * n / (n - k) for k, a in enumerate(acf)]
    out, phi = [1.0], []
    for k in range(1, len(r)):
        top = r[k] - sum(p * r[k - 1 - i] for i, p in enumerate(phi))
        low = 1 - sum(p * r[i + 1] for i, p in enumerate(phi))
        last = top / low if low else 0.0
        phi = [p - last * q for p, q in zip(phi, reversed(phi), strict=True)] + [last]
        out.append(last)
    return out


def acf_pacf(df: DataFrame, time: str, value: str, nlags: int | None = None, alpha: float = 0.05) -> dict:
    """Both functions with the lags whose Bartlett (or 1/sqrt n) interval around zero they leave, and orders they suggest."""
    n = series(df, time, value).count()
    nlags = nlags or max(1, min(int(10 * math.log10(n)), n - 1))
    acf = [r.acf for r in autocorrelation(df, time, value, nlags).orderBy("lag").collect()]
    pacf, z = partial_autocorrelation(acf, n), S.normal_ppf(1 - alpha / 2)
    band = [z * math.sqrt((1 + 2 * sum(a * a for a in acf[1:k])) / n) for k in range(1, nlags + 1)]
    q = [k for k in range(1, nlags + 1) if abs(acf[k]) > band[k - 1]]
    p = [k for k in range(1, nlags + 1) if abs(pacf[k]) > z / math.sqrt(n)]
    run = lambda lags: next(k for k in range(len(lags) + 1) if k == len(lags) or lags[k] != k + 1)
    return {"acf": acf, "pacf": pacf, "significant_acf": q, "significant_pacf": p, "suggested_q": run(q), "suggested_p": run(p)}


def ljung_box(df: DataFrame, time: str, value: str, lags: int | None = None) -> list[dict]:
    n = series(df, time, value).count()
    lags = lags or max(1, min(10, n // 5))
    acf = [r.acf for r in autocorrelation(df, time, value, lags).orderBy("lag").collect()]
    q, out = 0.0, []
    for k in range(1, lags + 1):
        q += n * (n + 2) * acf[k] ** 2 / (n - k)
        out.append({"lag": k, "q": q, "p_value": S.chi2_sf(q, k)})
    return out


def cross_correlation(left: DataFrame, right: DataFrame, time: str, a: str, b: str, max_lag: int) -> DataFrame:
    """(lag, ccf) of a and b shifted back, over the times both have; biased by n."""
    x, y = series(left, time, a).groupBy("t").agg(F.avg("v").alias("x")), series(right, time, b).groupBy("t").agg(F.avg("v").alias("y"))
    both = x.join(y, "t")
    stats = both.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("t")
    d = both.crossJoin(F.broadcast(stats)).withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})  # one row
    wide = d.select("dy", "sx", "sy", "n", "dx", *[F.lead("dx", k).over(w).alias(f"dx{k}") for k in range(1, max_lag + 1)])
    scale = F.max(F.col("n") * F.col("sx") * F.col("sy"))
    one = wide.agg(scale.alias("scale"), F.sum(F.col("dx") * F.col("dy")).alias("s0"), *[F.sum(F.col(f"dx{k}") * F.col("dy")).alias(f"s{k}") for k in range(1, max_lag + 1)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.try_divide(f"s{k}", "scale").alias("ccf")) for k in range(max_lag + 1)])))


def interpret_cross(r: float, lag: int) -> str:
    size = "strong" if abs(r) >= 0.7 else "moderate" if abs(r) >= 0.3 else "weak"
    return f"{size} {'positive' if r > 0 else 'negative'} correlation" + (f" at lag {lag}" if lag else " without lag")


# On one series' values --------------------------------------------------------------------------


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their standard errors and the residual sum of squares."""
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    rss = float(((y - x @ beta) ** 2).sum())
    return beta, np.sqrt(np.maximum(np.diag(inv) * rss / max(1, len(y) - x.shape[1]), 0)), rss


def adf(values: np.ndarray, max_lag: int | None = None) -> dict:
    """Augmented Dickey-Fuller with a constant, lag by the least AIC; p by MacKinnon's approximation."""
    v = np.asarray(values, dtype=float)
    n, d = len(v), np.diff(v)
    most = int(min(12 * (n / 100) ** 0.25, n // 2 - 2)) if max_lag is None else max_lag

    def fit(lags: int, start: int) -> tuple[float, float]:
        y = d[start:]
        x = np.column_stack([v[start:-1], *[d[start - k : len(d) - k] for k in range(1, lags + 1)], np.ones(len(y))])
        beta, se, rss = ols(x, y)
        return beta[0] / se[0] if se[0] else -math.inf, len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * x.shape[1]

    lag = min(range(most + 1), key=lambda k: fit(k, most)[1])
    t = fit(lag, lag)[0]
    return {"statistic": t, "lags": lag, "p_value": mackinnon_p(t), "stationary": mackinnon_p(t) < 0.05}


def mackinnon_p(t: float) -> float:
    """MacKinnon (1994), constant, one variable: fixed polynomial coefficients below and above the split."""
    if t > 2.74 or t < -18.83:
        return float(t > 2.74)
    return S.normal_cdf(np.polyval([0.03826, 1.4412, 2.1659], t) if t <= -1.61 else np.polyval([-0.01036, -0.12745, 0.93202, 1.7339], t))


def kpss(values: np.ndarray, regression: str = "c") -> dict:
    v = np.asarray(values, dtype=float)
    n = len(v)
    x = np.ones((n, 1)) if regression == "c" else np.column_stack([np.ones(n), np.arange(n)])
    e = v - x @ ols(x, v)[0]
    lags = min(int(math.ceil(12 * (n / 100) ** 0.25)), n - 1)
    variance = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
    statistic = float((np.cumsum(e) ** 2).sum() / (n * n * variance)) if variance > 0 else 0.0
    # Fixed critical values of Kwiatkowski et al. (1992) at 10, 5, 2.5 and 1 per cent.
    critical = (0.347, 0.463, 0.574, 0.739) if regression == "c" else (0.119, 0.146, 0.176, 0.216)
    p = float(np.interp(statistic, critical, (0.10, 0.05, 0.025, 0.01)))
    return {"statistic": statistic, "p_value": p, "stationary": p > 0.05}


def stationarity(df: DataFrame, time: str, value: str) -> dict:
    """ADF and KPSS of one series (its values come to the driver in order)."""
    v = np.array([r.v for r in series(df, time, value).orderBy("t", "v").select("v").collect()])
    a, k = adf(v), kpss(v)
    verdict = {(True, True): "stationary", (False, False): "non-stationary", (True, False): "difference stationary", (False, True): "trend stationary"}[a["stationary"], k["stationary"]]
    advice = {"stationary": "use as it is", "non-stationary": "difference it", "difference stationary": "difference it", "trend stationary": "remove its trend"}[verdict]
    return {"adf": a, "kpss": k, "conclusion": verdict, "recommendation": advice}


def detect_period(v: np.ndarray) -> int | None:
    n = len(v)
    if n < 4:
        return None
    i = np.arange(n)
    power = np.abs(np.fft.rfft(v - np.polyval(np.polyfit(i, v, 1), i))) ** 2
    power[0] = 0
    period = int(n / int(power.argmax())) if power.max() > 0 else 0
    return period if 2 <= period <= n // 2 else None


def loess(y: np.ndarray, span: int, degree: int = 1, weights: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    n = len(y)
    x = np.arange(n, dtype=float)
    at = x if at is None else at
    q = min(span, n)
    out = np.empty(len(at))
    for j, a in enumerate(at):
        low = int(np.clip(round(a - q / 2), 0, n - q))
        part = slice(low, low + q)
        reach = max(abs(a - x[low]), abs(a - x[low + q - 1])) * (1 if span <= n else span / n) or 1.0
        w = np.clip(1 - np.clip(np.abs(x[part] - a) / (reach * 1.001), 0, 1) ** 3, 0, None) ** 3
        w = w if weights is None else w * weights[part]
        if w.sum() <= 0:
            out[j] = y[part].mean()
            continue
        centre = (w * x[part]).sum() / w.sum()
        level = (w * y[part]).sum() / w.sum()
        spread = (w * (x[part] - centre) ** 2).sum()
        out[j] = level + ((w * (x[part] - centre) * y[part]).sum() / spread * (a - centre) if degree and spread > 1e-12 else 0.0)
    return out


def stl(y: np.ndarray, period: int, seasonal: int = 7, robust: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Season, trend and remainder by loess, two inner passes and some robust ones."""
    n, trend, weights = len(y), np.zeros(len(y)), None
    trend_span = int(math.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1
    season = np.zeros(n)
    for outer in range(robust + 1):
        for _ in range(2):
            d = y - trend
            cycle = np.empty(n + 2 * period)
            for phase in range(period):
                own = d[phase::period]
                w = None if weights is None else weights[phase::period]
                cycle[phase::period] = loess(own, seasonal, 1, w, np.arange(-1, len(own) + 1, dtype=float))[: len(cycle[phase::period])]
            smooth = lambda v, k: np.convolve(v, np.ones(k) / k, "valid")
            low = loess(smooth(smooth(smooth(cycle, period), period), 3), period | 1)
            season = cycle[period : period + n] - low[:n]
            trend = loess(y - season, trend_span, 1, weights)
        rest = y - season - trend
        h = 6 * np.median(np.abs(rest))
        weights = np.clip(1 - np.clip(np.abs(rest) / h, 0, 1) ** 2, 0, None) ** 2 if h > 0 and outer < robust else weights
    return season, trend, y - season - trend


def stl_anomalies(df: DataFrame, time: str, value: str, period: int | None = None, threshold: float = 3.0, by: list[str] | None = None) -> DataFrame:
    """(by..., t, v, anomaly_score, is_anomaly): remainders beyond threshold deviations, one series a task."""
    keys = by or []
    s = series(df, time, value, by).withColumn("one", F.lit(1))
    fields = [f for f in s.schema.fields if f.name in keys]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "v"])
        v = pdf["v"].to_numpy(dtype=float)
        p = period or detect_period(v) or 2
        if len(v) < 2 * p + 1:
            score = np.zeros(len(v))
        else:
            rest = stl(v, p)[2]
            score = np.abs(rest) / (rest.std() or 1.0)
        return pdf.drop(columns="one").assign(anomaly_score=score, is_anomaly=score > threshold)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "t timestamp", "v double", "anomaly_score double", "is_anomaly boolean"])
    return s.groupBy(*(keys or ["one"])).applyInPandas(run, schema)


def arima_css(v: np.ndarray, p: int, d: int, q: int) -> dict | None:
    """Conditional-sum-of-squares fit by Hannan-Rissanen start and Gauss-Newton steps."""
    y = np.diff(v, d) if d else np.asarray(v, dtype=float)
    n, k = len(y), p + q + 1
    if n < 3 * k + 5:
        return None
    mean = y.mean()
    z = y - mean

    def errors(theta: np.ndarray) -> np.ndarray:
        e = np.zeros(n)
        c, ar, ma = theta[0], theta[1 : 1 + p], theta[1 + p :]
        for t in range(p, n):
            e[t] = z[t] - c - sum(ar[i] * z[t - 1 - i] for i in range(p)) - sum(ma[j] * e[t - 1 - j] for j in range(q) if t - 1 - j >= 0)
        return e[p:]

    theta = np.zeros(k)
    if p or q:
        m = max(p, q) + 2
        x = np.column_stack([z[m - i - 1 : n - i - 1] for i in range(m)])
        long = z[m:] - x @ np.linalg.lstsq(x, z[m:], rcond=None)[0]
        start = max(p, q)
        w = np.column_stack([np.ones(len(long) - start), *[z[m + start - 1 - i : n - 1 - i] for i in range(p)], *[long[start - 1 - j : len(long) - 1 - j] for j in range(q)]])
        theta = np.clip(np.linalg.lstsq(w, z[m + start :], rcond=None)[0], -0.95, 0.95)
    best = errors(theta)
    for _ in range(25):
        step = 1e-5
        jacobian = np.column_stack([(errors(theta + step * np.eye(k)[i]) - best) / step for i in range(k)])
        delta = np.linalg.lstsq(jacobian, -best, rcond=None)[0]
        moved = False
        for shrink in (1.0, 0.5, 0.25, 0.1):
            trial = theta + shrink * delta
            with np.errstate(all="ignore"):
                e = errors(trial)
            if np.isfinite(e).all() and e @ e < best @ best - 1e-12:
                theta, best, moved = trial, e, True
                break
        if not moved:
            break
    variance = float(best @ best) / len(best)
    if not np.isfinite(variance) or variance <= 0:
        return None
    loglik = -0.5 * len(best) * (math.log(2 * math.pi * variance) + 1)
    return {"order": (p, d, q), "theta": theta.tolist(), "mean": float(mean), "sigma2": variance, "aic": 2 * (k + 1) - 2 * loglik, "bic": (k + 1) * math.log(len(best)) - 2 * loglik, "errors": best}


def auto_arima(df: DataFrame, time: str, value: str, max_p: int = 5, max_d: int = 2, max_q: int = 5, criterion: str = "aic") -> dict:
    """The order of least criterion; each order is fitted by its own task, failures are skipped."""
    spark = df.sparkSession
    v = [r.v for r in series(df, time, value).orderBy("t", "v").select("v").collect()]
    orders = [(p, d, q) for p in range(max_p + 1) for d in range(max_d + 1) for q in range(max_q + 1)]
    grid = spark.createDataFrame(orders, "p int, d int, q int")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = arima_css(np.array(v), *(int(x) for x in pdf.iloc[0]))
        return pd.DataFrame({"p": pdf["p"], "d": pdf["d"], "q": pdf["q"], "score": [None if fit is None else fit[criterion]]})

    scores = grid.groupBy("p", "d", "q").applyInPandas(run, "p int, d int, q int, score double").where("score is not null").collect()
    if not scores:
        raise ValueError("no order could be fitted")
    best = min(scores, key=lambda r: (r.score, r.p, r.d, r.q))
    return arima_css(np.array(v), best.p, best.d, best.q) | {"values": v, criterion: best.score}


def forecast(fit: dict, steps: int, alpha: float = 0.05) -> list[dict]:
    """Means and intervals by the difference equation and psi weights."""
    (p, d, q), theta = fit["order"], fit["theta"]
    c, ar, ma = theta[0], theta[1 : 1 + p], theta[1 + p :]
    levels = [np.asarray(fit["values"], dtype=float)]
    for _ in range(d):
        levels.append(np.diff(levels[-1]))
    z, e = list(levels[-1] - fit["mean"]), [0.0] * p + list(fit["errors"])
    ahead = []
    for _ in range(steps):
        z.append(c + sum(a * z[-1 - i] for i, a in enumerate(ar)) + sum(m * e[-1 - j] for j, m in enumerate(ma) if len(e) > j))
        e.append(0.0)
        ahead.append(z[-1] + fit["mean"])
    out = np.array(ahead)
    for level in reversed(levels[:-1]):
        out = level[-1] + np.cumsum(out)
    # AR polynomial with the differences multiplied in.
    poly = np.array([1.0, *[-a for a in ar]])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    psi = [1.0]
    for k in range(1, steps):
        psi.append((ma[k - 1] if k <= q else 0.0) - sum(poly[i] * psi[k - i] for i in range(1, min(k, len(poly) - 1) + 1)))
    z_score = S.normal_ppf(1 - alpha / 2)
    spread = [math.sqrt(fit["sigma2"] * sum(w * w for w in psi[: k + 1])) for k in range(steps)]
    return [{"step": k + 1, "mean": float(m), "lower": float(m - z_score * s), "upper": float(m + z_score * s)} for k, (m, s) in enumerate(zip(out, spread, strict=True))]


def sessions(df: DataFrame, time: str, by: list[str], gap: str = "30 minutes") -> DataFrame:
    """Batch session windows per key: start, end, events."""
    t = col(time).cast("timestamp")
    return df.where(t.isNotNull()).groupBy(*[col(c) for c in by], F.session_window(t, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(*[col(c) for c in by], F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def analyze(df: DataFrame, time: str, value: str, period: int | None = None, horizon: int = 0) -> dict:
    """Basic facts, stationarity, trend, season, autocorrelation and a forecast; a stage that fails is None with its error."""
    out: dict = {}

    def stage(name: str, run) -> None:
        try:
            out[name] = run()
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as error:
            out[name], out.setdefault("errors", {})[name] = None, str(error)

    stage("basic", lambda: basic_info(df, time, value).first().asDict())
    stage("stationarity", lambda: stationarity(df, time, value))
    stage("trend", lambda: trend_test(df, time, value) | {"mann_kendall": mann_kendall(df, time, value)})
    if period:
        stage("seasonality", lambda: seasonality_test(df, time, value, period))
        stage("decomposition", lambda: component_strength(decompose(df, time, value, period)).first().asDict())
    stage("autocorrelation", lambda: acf_pacf(df, time, value))
    if horizon:
        stage("forecast", lambda: forecast(auto_arima(df, time, value, 2, 1, 2), horizon))
    return out


def strength_column(c: Column) -> Column:
    return F.when(c >= 0.8, "very strong").when(c >= 0.6, "strong").when(c >= 0.4, "moderate").when(c >= 0.2, "weak").otherwise("very weak")
