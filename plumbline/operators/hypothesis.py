"""Hypothesis tests: Spark reduces to per-group sums, ranks or small tables; p-values are scalar mathematics on the driver."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import special as S
from ..functions.columns import col, normalize, number
from .correlation import average_ranks


class TestError(ValueError):
    """The data don't allow the test."""

    __test__ = False


def samples(df: DataFrame, value: str, group: str) -> DataFrame:
    """(g, v) with neither missing."""
    return normalize(df).select(col(group).cast("string").alias("g"), number(value).alias("v")).where("g is not null and v is not null")


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    return samples(df, value, group).groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("variance"))


def anova_table(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: groups, n, sums of squares between and within, F, eta squared."""
    m = group_moments(df, value, group)
    grand = F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy(F.lit(0))) / F.sum("n").over(Window.partitionBy(F.lit(0)))
    parts = m.withColumn("grand", grand)
    one = parts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2))).alias("ss_between"), F.sum((F.col("n") - 1) * F.coalesce("variance", F.lit(0.0))).alias("ss_within"))
    f = F.try_divide(F.col("ss_between") / F.nullif(F.col("k") - 1, F.lit(0)), F.col("ss_within") / F.nullif(F.col("n") - F.col("k"), F.lit(0)))
    return one.select(F.col("k").alias("groups"), "n", "ss_between", "ss_within", f.alias("f"), F.try_divide("ss_between", F.col("ss_between") + F.col("ss_within")).alias("eta_squared"))


def one_way_anova(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> dict:
    r = anova_table(df, value, group).first()
    if r.groups < 2:
        raise TestError("at least two groups are needed")
    p = S.f_sf(r.f, r.groups - 1, r.n - r.groups) if r.f is not None else None
    return {"test": "one_way_anova", "f": r.f, "p_value": p, "groups": r.groups, "n": r.n, "eta_squared": r.eta_squared, "effect": interpret_eta_squared(r.eta_squared or 0.0), "significant": p is not None and p < alpha}


def anova_assumptions(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> dict:
    """Normality within each group of at least three values and equal variances, with advice."""
    v = samples(df, value, group)
    names = [r.g for r in group_moments(df, value, group).where("n >= 3").select("g").orderBy("g").collect()]
    normal = {g: normality(v.where(F.col("g") == g), "v", alpha).get("likely_normal", False) for g in names}
    equal = levene(df, value, group)["equal_variances"]
    advice = "the assumptions hold" if all(normal.values()) and equal else "use Kruskal-Wallis" if not all(normal.values()) else "variances differ: compare with care"
    return {"normal": normal, "equal_variances": equal, "recommendation": advice}


def two_way_anova(df: DataFrame, value: str, a: str, b: str) -> list[dict]:
    """Type II sums of squares with interaction, by normal equations over the cells' counts and sums."""
    cells = normalize(df).select(col(a).cast("string").alias("a"), col(b).cast("string").alias("b"), number(value).alias("v")).na.drop()
    rows = cells.groupBy("a", "b").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss")).collect()
    la, lb = sorted({r.a for r in rows}), sorted({r.b for r in rows})
    n, s = np.array([r.n for r in rows], dtype=float), np.array([r.s for r in rows])
    total = sum(r.ss for r in rows)
    dummy = lambda levels, key: np.array([[float(getattr(r, key) == x) for x in levels[1:]] for r in rows]).reshape(len(rows), -1)
    one, da, db = np.ones((len(rows), 1)), dummy(la, "a"), dummy(lb, "b")
    both = np.hstack([da[:, [i]] * db[:, [j]] for i in range(da.shape[1]) for j in range(db.shape[1])]) if da.size and db.size else np.zeros((len(rows), 0))

    def rss(*parts: np.ndarray) -> tuple[float, int]:
        x = np.hstack(parts)
        beta = np.linalg.pinv(x.T @ (x * n[:, None])) @ (x.T @ s)
        return total - float(beta @ (x.T @ s)), int(np.linalg.matrix_rank(x))

    full, rank = rss(one, da, db, both)
    main, main_rank = rss(one, da, db)
    df_error = n.sum() - rank
    out = []
    for name, (reduced, reduced_rank), (bigger, bigger_rank) in ((a, rss(one, db), (main, main_rank)), (b, rss(one, da), (main, main_rank)), (f"{a}:{b}", (main, main_rank), (full, rank))):
        freedom = bigger_rank - reduced_rank
        f = (reduced - bigger) / freedom / (full / df_error) if freedom and full > 0 else None
        out.append({"term": name, "ss": reduced - bigger, "df": freedom, "f": f, "p_value": S.f_sf(f, freedom, df_error) if f is not None else None})
    return [*out, {"term": "residual", "ss": full, "df": int(df_error), "f": None, "p_value": None}]


def tukey_hsd(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> list[dict]:
    """Tukey-Kramer comparisons of every two groups."""
    rows = sorted(group_moments(df, value, group).collect(), key=lambda r: r.g)
    k, freedom = len(rows), sum(r.n - 1 for r in rows)
    mse = sum((r.n - 1) * (r.variance or 0.0) for r in rows) / freedom
    reach, out = S.studentized_range_ppf(1 - alpha, k, freedom), []
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            se = math.sqrt(mse / 2 * (1 / x.n + 1 / y.n))
            diff = y.mean - x.mean
            q = abs(diff) / se if se else 0.0 if diff == 0 else math.inf
            p = S.studentized_range_sf(q, k, freedom) if se else float(diff == 0)
            out.append({"group1": x.g, "group2": y.g, "mean_difference": diff, "q": q, "lower": diff - reach * se, "upper": diff + reach * se, "p_adjusted": p, "reject": p < alpha})
    return out


def bonferroni(p_values: list[float]) -> list[float]:
    return [min(1.0, p * len(p_values)) for p in p_values]


def holm(p_values: list[float]) -> list[float]:
    order, out, floor = sorted(range(len(p_values)), key=p_values.__getitem__), [0.0] * len(p_values), 0.0
    for rank, i in enumerate(order):
        floor = max(floor, min(1.0, (len(p_values) - rank) * p_values[i]))
        out[i] = floor
    return out


def corrected(df: DataFrame, p: str) -> DataFrame:
    """df with bonferroni and holm columns; tests are few, so one window over all is small."""
    every, ordered = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(p)
    m = F.count(F.lit(1)).over(every)
    step = df.withColumns({"bonferroni": F.least(F.lit(1.0), col(p) * m), "_step": F.least(F.lit(1.0), (m - F.row_number().over(ordered) + 1) * col(p))})
    return step.withColumn("holm", F.max("_step").over(ordered)).drop("_step")


def rank_sums(df: DataFrame, value: str, group: str) -> DataFrame:
    """(g, n, rank_sum, ties): rank sums per group over average ranks, and the tie term on every row."""
    v = samples(df, value, group)
    ranks = average_ranks(v, "v", [])
    cells = v.groupBy("g", "v").agg(F.count(F.lit(1)).alias("w")).join(ranks.select("v", "rank"), "v")
    ties = ranks.agg(F.sum(F.pow(F.col("_ties").cast("double"), F.lit(3)) - F.col("_ties")).alias("ties"))
    return cells.groupBy("g").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("rank")).alias("rank_sum")).crossJoin(F.broadcast(ties))  # one row


def exact_u_p(u: float, n: int, m: int) -> float:
    """Two-sided exact p of U without ties by counting subsets."""
    counts = np.zeros((n + 1, n * m + 1))
    counts[0, 0] = 1
    for j in range(1, n + m + 1):
        for i in range(min(j, n), 0, -1):
            shift = j - i
            if shift <= n * m:
                counts[i, shift:] += counts[i - 1, : n * m + 1 - shift]
    probabilities = counts[n] / counts[n].sum()
    tail = probabilities[int(max(u, n * m - u)) :].sum()
    return float(min(1.0, 2 * tail))


def mann_whitney(df: DataFrame, value: str, group: str, alternative: str = "two-sided") -> dict:
    rows = sorted(rank_sums(df, value, group).collect(), key=lambda r: r.g)
    if len(rows) != 2:
        raise TestError("exactly two groups are needed")
    (a, b), ties = rows, rows[0].ties
    u, n = a.rank_sum - a.n * (a.n + 1) / 2, a.n + b.n
    mean, spread = a.n * b.n / 2, math.sqrt(a.n * b.n / 12 * ((n + 1) - ties / (n * (n - 1))))
    if min(a.n, b.n) <= 8 and ties == 0 and alternative == "two-sided":
        p = exact_u_p(u, a.n, b.n)
    elif spread == 0:
        p = 1.0
    elif alternative == "two-sided":
        p = min(1.0, 2 * S.normal_sf((abs(u - mean) - 0.5) / spread))
    else:
        p = S.normal_sf(((u - mean) * (1 if alternative == "greater" else -1) - 0.5) / spread)
    r = 1 - 2 * u / (a.n * b.n)
    return {"test": "mann_whitney_u", "u": u, "p_value": p, "rank_biserial": r, "effect": interpret_rank_biserial(r)}


def kruskal_table(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: tie-corrected H, groups, n, epsilon squared."""
    one = rank_sums(df, value, group).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), F.max("ties").alias("ties"))
    n = F.col("n").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    return one.select(h.alias("h"), "groups", "n").withColumn("epsilon_squared", F.try_divide(F.col("h") - F.col("groups") + 1, F.col("n") - F.col("groups")))


def kruskal_wallis(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> dict:
    r = kruskal_table(df, value, group).first()
    if r.groups < 2:
        raise TestError("at least two groups are needed")
    p = S.chi2_sf(r.h, r.groups - 1)
    return {"test": "kruskal_wallis", "h": r.h, "p_value": p, "epsilon_squared": r.epsilon_squared, "effect": interpret_epsilon_squared(r.epsilon_squared), "significant": p < alpha}


def signed_rank_table(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """One row: W+ and W- of non-zero differences, their number and the tie term."""
    d = normalize(df).select((number(x) - (number(y) if y else F.lit(0.0))).alias("d")).where("d is not null and d != 0")
    ranks = average_ranks(d.select(F.abs("d").alias("v")), "v", [])
    cells = d.groupBy(F.abs("d").alias("v")).agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down")).join(ranks, "v")
    return cells.agg(F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum(F.col("down") * F.col("rank")).alias("w_minus"), F.sum("_ties").alias("n"), F.sum(F.pow(F.col("_ties").cast("double"), F.lit(3)) - F.col("_ties")).alias("ties"))


def wilcoxon(df: DataFrame, x: str, y: str | None = None) -> dict:
    r = signed_rank_table(df, x, y).first()
    if not r.n:
        raise TestError("no differences")
    mean, spread = r.n * (r.n + 1) / 4, math.sqrt(r.n * (r.n + 1) * (2 * r.n + 1) / 24 - r.ties / 48)
    w = min(r.w_plus, r.w_minus)
    return {"test": "wilcoxon", "w": w, "n": r.n, "p_value": min(1.0, 2 * S.normal_sf(abs(w - mean) / spread)) if spread else 1.0}


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, observed, expected) of every pair of observed levels."""
    both = normalize(df).select(col(a).cast("string").alias("a"), col(b).cast("string").alias("b")).where("a is not null and b is not null")
    cells = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("observed"))
    rows, columns = cells.groupBy("a").agg(F.sum("observed").alias("ra")), cells.groupBy("b").agg(F.sum("observed").alias("cb"))
    grid = rows.crossJoin(columns).join(cells, ["a", "b"], "left").fillna(0, ["observed"])  # levels of two categories
    total = F.sum("observed").over(Window.partitionBy(F.lit(0)))
    return grid.select("a", "b", "observed", (F.col("ra") * F.col("cb") / total.cast("double")).alias("expected"))


def chi_square_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi-squared (Yates-corrected for one degree of freedom), degrees, n, Cramer's V, smallest expected count."""
    cells = contingency(df, a, b)
    one = cells.agg(F.count_distinct("a").alias("ra"), F.count_distinct("b").alias("cb"), F.sum("observed").alias("n"), F.min("expected").alias("min_expected"),
                    F.sum(F.pow(F.abs(F.col("observed") - F.col("expected")), F.lit(2)) / F.col("expected")).alias("plain"),
                    F.sum(F.pow(F.greatest(F.abs(F.col("observed") - F.col("expected")) - 0.5, F.lit(0.0)), F.lit(2)) / F.col("expected")).alias("yates"))
    dof = (F.col("ra") - 1) * (F.col("cb") - 1)
    chi2 = F.when(dof == 1, F.col("yates")).otherwise(F.col("plain"))
    return one.select(chi2.alias("chi2"), dof.alias("dof"), "n", F.sqrt(F.try_divide(chi2, F.col("n") * (F.least("ra", "cb") - 1))).alias("cramers_v"), "min_expected")


def chi_square(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> dict:
    r = chi_square_table(df, a, b).first()
    p = S.chi2_sf(r.chi2, r.dof) if r.dof else 1.0
    return {"test": "chi_square", "chi2": r.chi2, "dof": r.dof, "p_value": p, "cramers_v": r.cramers_v, "effect": interpret_cramers_v(r.cramers_v or 0.0), "assumptions_met": r.min_expected >= 5, "significant": p < alpha}


def _two_by_two(df: DataFrame, a: str, b: str) -> list[list[int]]:
    rows = contingency(df, a, b).limit(5).collect()
    la, lb = sorted({r.a for r in rows}), sorted({r.b for r in rows})
    if (len(la), len(lb)) != (2, 2):
        raise TestError("a 2 x 2 table is needed")
    found = {(r.a, r.b): r.observed for r in rows}
    return [[found[x, y] for y in lb] for x in la]


def fisher_exact(df: DataFrame, a: str, b: str) -> dict:
    (w, x), (y, z) = _two_by_two(df, a, b)
    return {"test": "fisher_exact", "odds_ratio": w * z / (x * y) if x * y else math.inf, "p_value": S.fisher_two_sided(w, x, y, z)}


def mcnemar(df: DataFrame, a: str, b: str) -> dict:
    (_, x), (y, _) = _two_by_two(df, a, b)
    chi2 = (abs(x - y) - 1) ** 2 / (x + y) if x + y else 0.0
    return {"test": "mcnemar", "b": x, "c": y, "p_value": S.binomial_two_sided(x, x + y) if x + y else 1.0, "chi2": chi2, "p_chi2": S.chi2_sf(chi2, 1)}


def levene_table(df: DataFrame, value: str, group: str, center: str = "median") -> DataFrame:
    """The one-way table of absolute deviations from each group's centre (median, mean, or trimmed mean)."""
    v = samples(df, value, group)
    if center == "mean":
        centres = v.groupBy("g").agg(F.avg("v").alias("c"))
    elif center == "median":
        centres = v.groupBy("g").agg(F.median("v").alias("c"))
    elif center == "trimmed":
        ends = v.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
        centres = v.join(ends, "g").where((F.col("v") >= F.col("q")[0]) & (F.col("v") <= F.col("q")[1])).groupBy("g").agg(F.avg("v").alias("c"))
    else:
        raise ValueError(f"unknown centre {center!r}")
    deviations = v.join(centres, "g").select("g", F.abs(F.col("v") - F.col("c")).alias("d"))  # a row per group
    return anova_table(deviations, "d", "g")


def levene(df: DataFrame, value: str, group: str, center: str = "median", alpha: float = 0.05) -> dict:
    r = levene_table(df, value, group, center).first()
    p = S.f_sf(r.f, r.groups - 1, r.n - r.groups) if r.f is not None else 1.0
    return {"test": "levene", "w": r.f, "p_value": p, "equal_variances": p >= alpha}


def bartlett_table(df: DataFrame, value: str, group: str) -> DataFrame:
    m = group_moments(df, value, group).where("n > 1")
    f = F.col("n") - 1
    one = m.agg(F.count(F.lit(1)).alias("k"), F.sum(f).alias("f"), F.sum(f * F.col("variance")).alias("fv"), F.sum(f * F.ln("variance")).alias("flv"), F.sum(1 / f).alias("inv"))
    t = (F.col("f") * F.ln(F.col("fv") / F.col("f")) - F.col("flv")) / (1 + (F.col("inv") - 1 / F.col("f")) / (3 * F.nullif(F.col("k") - 1, F.lit(0))))
    return one.select(t.alias("t"), F.col("k").alias("groups"))


def bartlett(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> dict:
    r = bartlett_table(df, value, group).first()
    p = S.chi2_sf(r.t, r.groups - 1)
    return {"test": "bartlett", "t": r.t, "p_value": p, "equal_variances": p >= alpha}


def cohens_d_table(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    m = group_moments(df, value, group)
    pick = lambda name, g: F.max(F.when(F.col("g") == g, F.col(name)))
    one = m.agg(*[pick(n, g).alias(f"{n}{i}") for i, g in enumerate((first, second)) for n in ("n", "mean", "variance")])
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("variance0") + (F.col("n1") - 1) * F.col("variance1")) / (F.col("n0") + F.col("n1") - 2))
    return one.select(F.coalesce(F.try_divide(F.col("mean0") - F.col("mean1"), pooled), F.lit(0.0)).alias("cohens_d"), F.col("n0").alias("n1"), F.col("n1").alias("n2"))


def t_test(df: DataFrame, value: str, group: str) -> dict:
    rows = sorted(group_moments(df, value, group).collect(), key=lambda r: r.g)
    if len(rows) != 2:
        raise TestError("exactly two groups are needed")
    a, b = rows
    pooled = ((a.n - 1) * a.variance + (b.n - 1) * b.variance) / (a.n + b.n - 2)
    t = (a.mean - b.mean) / math.sqrt(pooled * (1 / a.n + 1 / b.n)) if pooled else 0.0
    d = (a.mean - b.mean) / math.sqrt(pooled) if pooled else 0.0
    return {"test": "t_test", "t": t, "p_value": S.t_two_sided(t, a.n + b.n - 2), "cohens_d": d, "effect": interpret_cohens_d(d)}


# Normality ---------------------------------------------------------------------------------------


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """W and p by Royston's approximation, for 3 to 5000 values."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([S.normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    c, u = m / math.sqrt(float(m @ m)), 1 / math.sqrt(n)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        # Royston's fixed polynomial coefficients.
        last = c[-1] + np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0], u)
        if n > 5:
            before = c[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
            phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            a = m / math.sqrt(phi)
            a[-1], a[-2], a[0], a[1] = last, before, -last, -before
        else:
            phi = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
            a[-1], a[0] = last, -last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if n <= 11:
        g = 0.459 * n - 2.273
        z = (-math.log(max(g - math.log(1 - w), 1e-300)) - np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n)) / math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = math.log(n)
        z = (math.log(max(1 - w, 1e-300)) - np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)) / math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, S.normal_sf(z)


def normality(df: DataFrame, column: str, alpha: float = 0.05, shapiro_limit: int = 5000) -> dict:
    """Shapiro-Wilk (up to 5000 values), Kolmogorov-Smirnov, Anderson-Darling and D'Agostino's K squared with a majority verdict.

    The empirical distribution is taken over distinct values with running counts; the standard normal distribution function
    of each comes from an Arrow-batched function.
    """
    v = normalize(df).select(number(column).alias("v")).where("v is not null")
    m = v.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.skewness("v").alias("g"), F.kurtosis("v").alias("k")).first()
    if m.n < 3 or not m.std:
        return {"column": column, "n": m.n, "message": "too few or constant values"}

    def curve(z: pd.Series) -> pd.DataFrame:
        low = [0.5 * math.erfc(-t / math.sqrt(2)) for t in z]
        high = [0.5 * math.erfc(t / math.sqrt(2)) for t in z]
        return pd.DataFrame({"cdf": low, "ln": [math.log(max(p, 1e-300)) for p in low], "lnc": [math.log(max(p, 1e-300)) for p in high]})

    normal = F.pandas_udf(curve, "struct<cdf: double, ln: double, lnc: double>")
    ranked = average_ranks(v, "v", []).withColumn("f", normal((F.col("v") - m.mean) / m.std))
    upto, below = (F.col("rank") + (F.col("_ties") - 1) / 2.0), (F.col("rank") - (F.col("_ties") + 1) / 2.0)
    # Sum over the tied places of (2i - 1) ln F + (2(n - i) + 1) ln(1 - F).
    place = F.col("_ties") * (2 * F.col("rank") - 1)
    one = ranked.agg(F.max(F.greatest(upto / m.n - F.col("f.cdf"), F.col("f.cdf") - below / m.n)).alias("d"), F.sum(place * F.col("f.ln") + F.col("_ties") * (2 * (m.n - F.col("rank")) + 1) * F.col("f.lnc")).alias("s")).first()
    a2 = -m.n - one.s / m.n
    critical = 0.787 / (1 + 4 / m.n - 25 / m.n**2)
    out = {"column": column, "n": m.n, "ks": {"d": one.d, "p_value": S.kolmogorov_sf(one.d, m.n)}, "anderson": {"a2": a2, "critical_5": critical}}
    votes = [out["ks"]["p_value"] > alpha, a2 < critical]
    if m.n >= 8:
        k2 = dagostino(m.n, m.g, m.k)
        out["dagostino"] = {"k2": k2, "p_value": S.chi2_sf(k2, 2)}
        votes.append(out["dagostino"]["p_value"] > alpha)
    if m.n <= shapiro_limit:
        w, p = shapiro_wilk([r.v for r in v.collect()])
        out["shapiro"] = {"w": w, "p_value": p}
        votes.append(p > alpha)
    return out | {"passed": sum(votes), "total": len(votes), "likely_normal": 2 * sum(votes) >= len(votes)}


def dagostino(n: int, g: float, k: float) -> float:
    """K squared from biased skewness and excess kurtosis."""
    y = g * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b - 1)) - 1
    scale = math.sqrt(2 / (w2 - 1))
    zs = math.asinh(y / scale) / math.sqrt(0.5 * math.log(w2))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (k + 3 - mean) / math.sqrt(var)
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / third * (2 / third + math.sqrt(1 + 4 / third**2))
    denominator = 1 + x * math.sqrt(2 / (a - 4))
    root = math.copysign(abs((1 - 2 / a) / denominator) ** (1 / 3), denominator) if denominator else 0.0
    return zs**2 + ((1 - 2 / (9 * a) - root) / math.sqrt(2 / (9 * a))) ** 2


# Managers ----------------------------------------------------------------------------------------


def compare_groups(df: DataFrame, value: str, group: str, parametric: bool | None = None, alpha: float = 0.05) -> dict:
    """Chooses by normality within groups and equal variances, unless told: t or Mann-Whitney for two groups, else ANOVA with Tukey or Kruskal-Wallis."""
    names = [r.g for r in group_moments(df, value, group).select("g").collect()]
    if len(names) < 2:
        raise TestError("at least two groups are needed")
    if parametric is None:
        v = samples(df, value, group)
        checks = [normality(v.where(F.col("g") == g), "v", alpha) for g in names]
        parametric = all(c.get("likely_normal", False) for c in checks) and levene(df, value, group)["equal_variances"]
    if len(names) == 2:
        return (t_test if parametric else mann_whitney)(df, value, group)
    if not parametric:
        return kruskal_wallis(df, value, group, alpha)
    out = one_way_anova(df, value, group, alpha)
    return out | ({"post_hoc": tukey_hsd(df, value, group, alpha)} if out["significant"] else {})


def association(df: DataFrame, a: str, b: str, method: str = "auto") -> dict:
    if method == "auto":
        r = chi_square_table(df, a, b).first()
        method = "fisher" if r.dof == 1 and r.min_expected < 5 else "chi_square"
    return {"fisher": fisher_exact, "chi_square": chi_square, "mcnemar": mcnemar}[method](df, a, b)


def granger(df: DataFrame, order: str, caused: str, causing: str, max_lag: int = 5, alpha: float = 0.05) -> dict:
    """Per lag the F, chi-squared and likelihood-ratio tests, from cross moments of lagged columns computed in one job.

    The series is one ordered window; it is meant for one series of moderate length, many are grouped by the caller.
    """
    base = normalize(df).select(col(order).alias("_t"), number(caused).alias("y"), number(causing).alias("x")).na.drop()
    w = Window.orderBy("_t")
    lags = {f"{n}{k}": F.lag(n, k).over(w) for k in range(1, max_lag + 1) for n in ("y", "x")}
    data = base.withColumns(lags)
    out = []
    for lag in range(1, max_lag + 1):
        own, other = [f"y{k}" for k in range(1, lag + 1)], [f"x{k}" for k in range(1, lag + 1)]
        names = ["one", *own, *other, "y"]
        rows = data.withColumn("one", F.lit(1.0)).select(*names).na.drop()
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        sums = rows.agg(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
        m = np.zeros((len(names), len(names)))
        for (i, j), s in zip(pairs, sums, strict=True):
            m[i, j] = m[j, i] = s
        n = m[0, 0]
        if n < lag + 10:
            raise TestError("too few rows")

        def rss(keep: list[int], m: np.ndarray = m) -> float:
            xy = m[keep, -1]
            return float(m[-1, -1] - xy @ np.linalg.pinv(m[np.ix_(keep, keep)]) @ xy)

        small, full = rss(list(range(1 + lag))), rss(list(range(1 + 2 * lag)))
        freedom = n - 2 * lag - 1
        f, chi2, lr = (small - full) / lag / (full / freedom), n * (small - full) / full, n * math.log(small / full)
        out.append({"lag": lag, "f": f, "p_value": S.f_sf(f, lag, freedom), "chi2": chi2, "p_chi2": S.chi2_sf(chi2, lag), "lr": lr, "p_lr": S.chi2_sf(lr, lag)})
    best = min(out, key=lambda r: r["p_value"])
    return {"lags": out, "causes": any(r["p_value"] < alpha for r in out), "best_lag": best["lag"]}


def _level(x: float, bounds: tuple[float, float, float]) -> str:
    return ("negligible", "small", "medium", "large")[sum(abs(x) >= b for b in bounds)]


def interpret_cohens_d(d: float) -> str:
    return _level(d, (0.2, 0.5, 0.8))


def interpret_eta_squared(e: float) -> str:
    return _level(e, (0.01, 0.06, 0.14))


def interpret_cramers_v(v: float) -> str:
    return _level(v, (0.1, 0.3, 0.5))


def interpret_rank_biserial(r: float) -> str:
    return _level(r, (0.1, 0.3, 0.5))


def interpret_epsilon_squared(e: float) -> str:
    return _level(e, (0.01, 0.08, 0.26))
