"""Correlation matrices in long form, strong pairs and variance inflation."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import FUSED, normalize, number, numeric_columns
from ..functions.special import normal_sf, t_two_sided


def varying_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Numeric columns with more than one value (one row comes back)."""
    columns = columns or numeric_columns(df)
    row = df.agg(*[(F.max(number(c)) > F.min(number(c))).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return [c for c, varies in zip(columns, row, strict=True) if varies]


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's r over rows with both values; null where one side does not vary there."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature1, feature2, r, n) for every pair in column order, pairwise complete; all pairs share few aggregates."""
    df = normalize(df)
    columns = varying_columns(df, columns)
    pairs = list(combinations(columns, 2))
    parts = []
    for at in range(0, len(pairs), FUSED // 2):
        some = pairs[at : at + FUSED // 2]
        one = df.agg(*[e for i, (a, b) in enumerate(some) for e in (safe_corr(number(a), number(b)).alias(f"r{i}"), F.count_if(number(a).isNotNull() & number(b).isNotNull()).alias(f"n{i}"))])
        parts.append(one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(some)]))))
    if not parts:
        return df.sparkSession.createDataFrame([], "feature1 string, feature2 string, r double, n long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ranged(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """df with _part, the range of its value, and _base, the rows (or weights) of all lower ranges.

    The ranges' bounds are approximate quantiles, fetched once (fewer than a thousand numbers) and then fixed, so a row's
    range doesn't depend on how a stage was dealt or run again.
    """
    parts = min(1_000, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ends = df.agg(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000).alias("e")).first().e
    bounds = F.array(*[F.lit(float(e)) for e in sorted(set(ends or []))])
    part = F.size(F.filter(bounds, lambda e: e < F.col(value).cast("double"))) if ends else F.lit(0)
    placed = df.withColumn("_part", part)
    sizes = placed.groupBy("_part").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_sum"))
    base = sizes.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(base), "_part")  # a row per range


def average_ranks(values: DataFrame, value: str, by: list[str], rank: str = "rank") -> DataFrame:
    """Each distinct value's average rank within by: counts per value, then running sums over distinct values only.

    Without by the running sum is taken in two levels (per range of values, then over the ranges), so no task holds all
    values.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    if by:
        before = F.sum("_ties").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
        return counts.withColumn(rank, F.coalesce(before, F.lit(0)) + (F.col("_ties") + 1) / 2.0)
    before = F.sum("_ties").over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return ranged(counts, value, "_ties").withColumn(rank, F.col("_base") + F.coalesce(before, F.lit(0)) + (F.col("_ties") + 1) / 2.0).drop("_part", "_base")


def pair_values(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(feature1, feature2, x, y) with both values, one narrow row per pair of columns."""
    parts = [F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), number(a).alias("x"), number(b).alias("y")) for a, b in pairs]
    return df.select(F.inline(F.array(*parts))).where("x is not null and y is not null")


def spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature1, feature2, r, n): Pearson's r of average ranks over each pair's complete rows.

    Columns without missing values have the same ranks in every pair: each is ranked once, by ranges of its values, and
    all their pairs share one aggregate. A pair with a column that misses values is ranked anew over its complete rows.
    """
    df = normalize(df)
    columns = varying_columns(df, columns)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "feature1 string, feature2 string, r double, n long")
    lost = df.agg(*[F.count_if(number(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    whole = [c for c, m in zip(columns, lost, strict=True) if not m]
    parts = [_whole_spearman(df, whole)] if len(whole) > 1 else []
    some = [(a, b) for a, b in combinations(columns, 2) if a not in whole or b not in whole]
    if some:
        parts.append(_pairwise_spearman(df, some))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def _whole_spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = values = df.select(*[number(c).alias(f"v{i}") for i, c in enumerate(columns)])
    for i in range(len(columns)):
        # Rows of a frequent value may be very many; adaptive execution splits them, a rank is one row per value.
        rows = rows.join(average_ranks(values.select(f"v{i}"), f"v{i}", [], f"r{i}").select(f"v{i}", f"r{i}"), f"v{i}")
    pairs = list(combinations(range(len(columns)), 2))
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[F.corr(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in pairs])
    parts = [F.struct(F.lit(columns[i]).alias("feature1"), F.lit(columns[j]).alias("feature2"), F.col(f"c{i}_{j}").alias("r"), F.col("n")) for i, j in pairs]
    return one.select(F.inline(F.array(*parts)))


def _pairwise_spearman(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Equal (x, y) collapse to weighted cells before ranking, and moments of ranks are weighted sums."""
    keys = ["feature1", "feature2"]
    cells = pair_values(df, pairs).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("w"))
    weighted = lambda v: cells.groupBy(*keys, v).agg(F.sum("w").alias("t"))

    def ranks(v: str, name: str) -> DataFrame:
        before = F.sum("t").over(Window.partitionBy(*keys).orderBy(v).rowsBetween(Window.unboundedPreceding, -1))
        return weighted(v).select(*keys, v, (F.coalesce(before, F.lit(0)) + (F.col("t") + 1) / 2.0).alias(name))

    ranked = cells.join(ranks("x", "rx"), [*keys, "x"]).join(ranks("y", "ry"), [*keys, "y"])
    w = F.col("w").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum("w").alias("n"), F.sum(w * F.col("rx") * F.col("ry")).alias("xy"), F.sum(w * F.col("rx") * F.col("rx")).alias("xx"), F.sum(w * F.col("ry") * F.col("ry")).alias("yy"))
    centre = F.col("n") * F.pow((F.col("n") + 1) / 2.0, F.lit(2))
    return sums.select(*keys, F.try_divide(F.col("xy") - centre, F.sqrt((F.col("xx") - centre) * (F.col("yy") - centre))).alias("r"), "n")


def kendall_tau_b(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float | None:
    """tau-b of weighted distinct cells by a Fenwick tree over y's ranks, n log n."""
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], w[order].astype(float)
    levels, code = np.unique(y, return_inverse=True)
    tree = [0.0] * (len(levels) + 1)
    below = above = 0.0
    seen, i = 0.0, 0

    def add(k: int, v: float) -> None:
        k += 1
        while k < len(tree):
            tree[k] += v
            k += k & -k

    def upto(k: int) -> float:
        s = 0.0
        while k > 0:
            s += tree[k]
            k -= k & -k
        return s

    while i < len(x):
        j = i
        while j < len(x) and x[j] == x[i]:
            j += 1
        for k in range(i, j):
            below += w[k] * upto(int(code[k]))
            above += w[k] * (seen - upto(int(code[k]) + 1))
        for k in range(i, j):
            add(int(code[k]), w[k])
            seen += w[k]
        i = j
    n0 = seen * (seen - 1) / 2
    ties = lambda v: sum(t * (t - 1) / 2 for t in np.bincount(np.unique(v, return_inverse=True)[1], weights=w))
    scale = math.sqrt((n0 - ties(x)) * (n0 - ties(y)))
    return (below - above) / scale if scale > 0 else None


def kendall(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """tau-b per pair. Cells of equal (x, y) are counted first; a pair's distinct cells go to one task."""
    df = normalize(df)
    cells = pair_values(df, list(combinations(varying_columns(df, columns), 2))).groupBy("feature1", "feature2", "x", "y").agg(F.count(F.lit(1)).alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tau = kendall_tau_b(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
        return pd.DataFrame({"feature1": [pdf["feature1"].iloc[0]], "feature2": [pdf["feature2"].iloc[0]], "r": [tau], "n": [int(pdf["w"].sum())]})

    return cells.groupBy("feature1", "feature2").applyInPandas(run, "feature1 string, feature2 string, r double, n long")


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size >= 0.9, "very_strong").when(size >= 0.7, "strong").when(size >= 0.5, "moderate").when(size >= 0.3, "weak").otherwise("very_weak")


def strong_pairs(df: DataFrame, threshold: float = 0.7, columns: list[str] | None = None) -> DataFrame:
    """Pearson pairs at or above the threshold, strongest first."""
    pairs = pearson(df, columns).where(F.abs("r") >= threshold)
    return pairs.select("feature1", "feature2", "r", "n", strength(F.col("r")).alias("strength"), F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction")).orderBy(F.desc(F.abs("r")), "feature1", "feature2")


def pair_p_value(r: float, n: int) -> float:
    if n < 3:
        return 1.0
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def kendall_p_value(tau: float, n: int) -> float:
    return 2 * normal_sf(abs(tau) * math.sqrt(9 * n * (n - 1) / (2 * (2 * n + 5)))) if n > 1 else 1.0


def vif(df: DataFrame, columns: list[str] | None = None) -> list[dict]:
    """Variance inflation on complete rows from one k x k correlation matrix; infinite first, then largest."""
    df = normalize(df)
    columns = varying_columns(df, columns)
    complete = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(columns)]).na.drop()
    row = complete.agg(*[F.corr(f"x{i}", f"x{j}").alias(f"r{i}_{j}") for i, j in combinations(range(len(columns)), 2)]).first() if len(columns) > 1 else None
    if row is None:
        return []
    m = np.eye(len(columns))
    for i, j in combinations(range(len(columns)), 2):
        m[i, j] = m[j, i] = row[f"r{i}_{j}"]
    out = []
    for i, c in enumerate(columns):
        rest = [j for j in range(len(columns)) if j != i]
        r2 = float(m[i, rest] @ np.linalg.pinv(m[np.ix_(rest, rest)]) @ m[rest, i])
        value = math.inf if r2 >= 0.9999 else 1 / (1 - r2)
        out.append({"feature": c, "vif": value, "high": value > 10, "interpretation": interpret_vif(value)})
    return sorted(out, key=lambda r: (-r["vif"], r["feature"]))


def interpret_vif(value: float) -> str:
    if math.isinf(value):
        return "perfect multicollinearity"
    return "severe multicollinearity" if value > 10 else "moderate multicollinearity" if value > 5 else "low multicollinearity"


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: least-squares line of y on x with r squared."""
    a, b = number(y), number(x)
    return normalize(df).agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"), F.regr_count(a, b).cast("long").alias("n"))


