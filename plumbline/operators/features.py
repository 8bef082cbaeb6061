"""Sampling and feature engineering: candidates come from fused aggregates, features are plain columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import categorical_columns, col, long_form, normalize, number, numeric_columns
from .correlation import pearson, ranged
from .quantiles import exact_quantiles, quantile_row

# Sampling ----------------------------------------------------------------------------------------


def auto_target(n: int) -> int:
    for bound, target in ((1_000, n), (10_000, 5_000), (100_000, 10_000), (1_000_000, 50_000)):
        if n <= bound:
            return target
    return min(int(10 * math.sqrt(n)), 100_000)


def _draw(key: list[str], seed: int) -> Column:
    """A pseudo-random order that depends on the row's key alone, so it survives retries and any partitioning."""
    return F.xxhash64(F.lit(seed), *[col(k) for k in key])


def random_sample(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (or all): a bounded top-n by the key's hash, taken in every partition before the last merge."""
    return df.orderBy(_draw(key, seed), *key).limit(n)


reservoir_sample = random_sample  # a uniform sample of n rows either way


def systematic_sample(df: DataFrame, n: int, key: list[str]) -> DataFrame:
    """The rows at floor(i * N / n) in key order, by ranged places instead of one ordered task.

    A numeric first key is cut into ranges; rows of another kind of key are ordered in one task.
    """
    total = df.count()
    if n >= total:
        return df
    if key[0] in numeric_columns(df):
        placed = ranged(df, key[0]).withColumn("_i", F.col("_base") + F.row_number().over(Window.partitionBy("_part").orderBy(*key)) - 1).drop("_part", "_base")
    else:
        placed = df.withColumn("_i", F.row_number().over(Window.orderBy(*key)) - 1)
    # Place i is taken if some j has floor(j * N / n) = i: j = ceil(i * n / N) is the only candidate.
    j = F.ceil(F.col("_i") * n / total)
    return placed.where((F.floor(j * total / n) == F.col("_i")) & (j < n)).drop("_i")


#: Strata and bytes of their names that are broadcast at most.
MOST_STRATA, STRATA_BYTES = 10_000, 64 << 20


def _of_strata(rows: DataFrame, stratum: str, strata: DataFrame, total: int) -> DataFrame:
    """rows joined with strata, which has a row per stratum: its name _s and the number of its rows _c.

    Few strata are broadcast. Of many, those above a MOST_STRATA-th of the rows are broadcast and the others shuffled, so no
    task gathers a large stratum.
    """
    same = col(stratum) == F.col("_s")
    one = strata.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col("_s").cast("string"))), F.lit(0)).alias("b")).first()
    if one.n <= MOST_STRATA and one.b <= STRATA_BYTES:
        return rows.join(F.broadcast(strata), same)
    large = strata.where(F.col("_c") > total // MOST_STRATA)
    others = rows.join(F.broadcast(large.select("_s")), same, "left_anti").join(strata.where(F.col("_c") <= total // MOST_STRATA), same)
    return rows.join(F.broadcast(large), same).unionByName(others)


def stratified_sample(df: DataFrame, n: int, stratum: str, key: list[str], seed: int = 42) -> DataFrame:
    """max(1, floor(n * share)) rows of every non-null stratum, first by the key's hash.

    A stratum's quota is a row of a joined table. Rows are thinned before ranking: only those whose hash lies below
    four times the quota's share (and at least a few hundred expected) can win, so a large stratum never meets in one task.
    """
    rows = df.where(col(stratum).isNotNull())
    sizes = rows.groupBy(col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    total = sizes.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    quota = sizes.select("_s", "_c", F.greatest(F.lit(1), F.floor(n * F.col("_c") / F.lit(total))).alias("_q"))
    draw = F.pmod(_draw(key, seed), F.lit(1 << 40))
    near = _of_strata(rows, stratum, quota, total).withColumn("_h", draw).where(F.col("_h") / float(1 << 40) <= (4.0 * F.col("_q") + 300) / F.col("_c"))
    # Keys that repeat share their hash: a stratum of few keys may fall short, and is then ranked whole.
    left = near.groupBy(F.col("_s").alias("_left")).agg(F.count(F.lit(1)).alias("_n"))
    short = quota.join(left, F.col("_s") == F.col("_left"), "left").where(F.coalesce("_n", F.lit(0)) < F.col("_q")).select("_s", "_c", "_q")
    if not short.isEmpty():
        near = near.join(short.select(F.col("_s").alias("_short")), F.col("_s") == F.col("_short"), "left_anti")
        whole = _of_strata(rows, stratum, short, total).withColumn("_h", draw).withColumn("_p", F.spark_partition_id())
        # Each partition ranks its own rows first, so that quotas meet in a task and not a stratum.
        first = whole.withColumn("_k", F.row_number().over(Window.partitionBy("_s", "_p").orderBy("_h", *key)))
        near = near.unionByName(first.where("_k <= _q").drop("_p", "_k"))
    ranked = near.withColumn("_k", F.row_number().over(Window.partitionBy("_s").orderBy("_h", *key)))
    return ranked.where("_k <= _q").drop("_s", "_c", "_q", "_h", "_k")


def smart_sample(df: DataFrame, key: list[str], n: int | None = None, method: str = "adaptive", stratum: str | None = None, seed: int = 42) -> tuple[DataFrame, dict]:
    total = df.count()
    n = auto_target(total) if n is None else n
    if total <= n:
        return df, {"method": "all", "rows": total, "sampled": total, "rate": 1.0}
    texts = [c for c in categorical_columns(df) if c not in key]
    if method == "adaptive":
        method = "stratified" if stratum or texts else "systematic" if total > 1_000_000 else "random"
    if method == "stratified":
        out = stratified_sample(df, n, stratum or texts[0], key, seed)
    elif method == "systematic":
        out = systematic_sample(df, n, key)
    elif method in ("random", "reservoir"):
        out = random_sample(df, n, key, seed)
    else:
        raise ValueError(f"unknown method {method!r}")
    return out, {"method": method, "rows": total, "sampled": n, "rate": n / total}


def visual_sample(df: DataFrame, key: list[str], max_points: int = 10_000, columns: list[str] | None = None) -> DataFrame:
    """At most about max_points rows, by the first string column of 2 to 20 levels if there is one."""
    chosen = df.select(*dict.fromkeys([*key, *(columns or df.columns)]))
    if chosen.count() <= max_points:
        return chosen
    levels = chosen.agg(*[F.approx_count_distinct(col(c)).alias(c) for c in categorical_columns(chosen)]).first() if categorical_columns(chosen) else {}
    few = next((c for c in categorical_columns(chosen) if 2 <= levels[c] <= 20), None)
    return stratified_sample(chosen, max_points, few, key) if few else random_sample(chosen, max_points, key)


def sample_size(population: int, margin: float = 0.05, confidence: float = 0.95, share: float = 0.5) -> int:
    from ..functions.special import normal_ppf

    n = normal_ppf((1 + confidence) / 2) ** 2 * share * (1 - share) / margin**2
    return math.ceil(n / (1 + (n - 1) / population)) if population else 0


def representativeness(df: DataFrame, sample: DataFrame, columns: list[str] | None = None, tolerance: float = 0.1) -> DataFrame:
    """Per numeric column both means and whether they differ by at most tolerance deviations of the whole."""
    columns = columns or numeric_columns(df)
    fields = {"mean": lambda c: F.avg(number(c)), "std": lambda c: F.stddev_samp(number(c))}
    whole, part = long_form(normalize(df), columns, "column_name", fields), long_form(normalize(sample), columns, "column_name", fields)
    both = whole.join(F.broadcast(part.select("column_name", F.col("mean").alias("sample_mean"))), "column_name")
    off = F.coalesce(F.try_divide(F.abs(F.col("mean") - F.col("sample_mean")), F.col("std")), F.lit(0.0))
    return both.select("column_name", "mean", "sample_mean", off.alias("difference"), (off <= tolerance).alias("representative"))


def narrow_types(df: DataFrame) -> DataFrame:
    """Advice per whole-number column: the narrowest type that holds its values."""
    whole = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")]
    rows = long_form(df, whole, "column_name", {"min": lambda c: F.min(col(c).cast("long")), "max": lambda c: F.max(col(c).cast("long"))})
    fits = lambda bits: (F.col("min") >= -(1 << (bits - 1))) & (F.col("max") < (1 << (bits - 1)))
    return rows.withColumn("narrowest", F.when(fits(8), "tinyint").when(fits(16), "smallint").when(fits(32), "int").otherwise("bigint"))


# Feature candidates --------------------------------------------------------------------------------


@dataclass
class Interaction:
    feature1: str
    feature2: str
    operation: str
    score: float
    reason: str = ""


@dataclass
class Polynomial:
    feature: str
    degree: int
    score: float
    reason: str = ""


@dataclass
class Binning:
    feature: str
    strategy: str
    n_bins: int
    edges: list[float]
    labels: list[str]


@dataclass
class Recommendation:
    feature: str
    choice: str
    reason: str
    alternatives: list[str] = field(default_factory=list)


OPERATIONS = {
    "multiply": lambda a, b: a * b, "divide": lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0))), "add": lambda a, b: a + b, "subtract": lambda a, b: a - b,
}


def interaction_columns(df: DataFrame, chosen: list[Interaction]) -> DataFrame:
    """df with {a}_{operation}_{b} columns; a zero denominator gives null."""
    return df.withColumns({f"{c.feature1}_{c.operation}_{c.feature2}": OPERATIONS[c.operation](number(c.feature1), number(c.feature2)) for c in chosen})


def binned_mutual_information(df: DataFrame, feature: Column, target: Column, bins: int = 20) -> float:
    """Mutual information in nats of equal-frequency bins of the feature and the target's values (binned if numeric)."""
    rows = df.select(feature.alias("f"), target.alias("t")).na.drop()
    edges = rows.agg(F.percentile_approx("f", F.array(*[F.lit(i / bins) for i in range(1, bins)]), 1000).alias("e")).first().e
    if not edges:
        return 0.0
    binned = rows.select(F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]), lambda e: e < F.col("f"))).alias("b"), "t")
    cells = binned.groupBy("b", "t").agg(F.count(F.lit(1)).alias("n"))
    both = cells.withColumns({"nb": F.sum("n").over(Window.partitionBy("b")), "nt": F.sum("n").over(Window.partitionBy("t")), "all": F.sum("n").over(Window.partitionBy(F.lit(0)))})
    p = F.col("n") / F.col("all")
    return both.agg(F.sum(p * F.ln(F.col("n") * F.col("all") / (F.col("nb") * F.col("nt").cast("double")))).alias("mi")).first().mi or 0.0


def detect_interactions(df: DataFrame, target: str | None = None, most: int = 10, correlation: float = 0.3, information: float = 0.1) -> list[Interaction]:
    df = normalize(df)
    columns = [c for c in numeric_columns(df) if c != target]
    found = [Interaction(r.feature1, r.feature2, "multiply", abs(r.r), f"correlation {r.r:.3f}") for r in pearson(df, columns).where(F.abs("r") > correlation).collect()]
    pairs = list(combinations(columns, 2))
    if pairs:
        ratios = df.agg(*[e for i, (a, b) in enumerate(pairs) for e in (F.var_samp(F.try_divide(number(a), number(b))).alias(f"r{i}"), F.var_samp(number(a)).alias(f"v{i}"), F.count_if(number(b) == 0).alias(f"z{i}"))]).first()
        for i, (a, b) in enumerate(pairs):
            ratio, own = ratios[f"r{i}"], ratios[f"v{i}"]
            if not ratios[f"z{i}"] and ratio is not None and own and ratio > 0.5 * own:
                found.append(Interaction(a, b, "divide", ratio / (ratio + own), "the ratio varies"))
    if target:
        levels = df.agg(F.approx_count_distinct(col(target))).first()[0]
        label = col(target).cast("string") if target not in numeric_columns(df) or levels < 20 else F.round(number(target), 0).cast("string")
        for a, b in pairs:
            for name in ("multiply", "add", "subtract"):
                mi = binned_mutual_information(df, OPERATIONS[name](number(a), number(b)), label)
                if mi > information:
                    found.append(Interaction(a, b, name, mi, f"mutual information {mi:.3f}"))
    return sorted(found, key=lambda c: (-c.score, c.feature1, c.feature2, c.operation))[:most]


def polynomial_columns(df: DataFrame, chosen: list[Polynomial]) -> DataFrame:
    return df.withColumns({f"{c.feature}_pow{c.degree}": F.pow(number(c.feature), F.lit(c.degree)) for c in chosen})


def detect_polynomials(df: DataFrame, target: str | None = None, max_degree: int = 3, most: int = 10, linearity: float = 0.95) -> list[Polynomial]:
    """With a target: gains of R squared by degree, from power sums of standardised features; without: by shape."""
    df = normalize(df)
    columns, found = [c for c in numeric_columns(df) if c != target], []
    if not columns:
        return []
    if target is None:
        row = df.agg(*[e for i, c in enumerate(columns) for e in (F.skewness(number(c)).alias(f"s{i}"), F.kurtosis(number(c)).alias(f"k{i}"))]).first()
        for i, c in enumerate(columns):
            s, k = row[f"s{i}"] or 0.0, row[f"k{i}"] or 0.0
            if abs(s) > 1 or abs(k) > 3:
                found.append(Polynomial(c, 2, abs(s) + abs(k) / 3, "skewed or heavy-tailed"))
        return sorted(found, key=lambda p: (-p.score, p.feature))[:most]
    for c in columns:
        rows = df.select(number(c).alias("x"), number(target).alias("y")).na.drop()
        m = rows.agg(F.avg("x").alias("m"), F.nullif(F.stddev_pop("x"), F.lit(0.0)).alias("s")).first()
        if m.s is None:
            continue
        z = (F.col("x") - m.m) / m.s
        sums = rows.agg(*[F.sum(F.pow(z, F.lit(k))).alias(f"x{k}") for k in range(2 * max_degree + 1)], *[F.sum(F.pow(z, F.lit(k)) * F.col("y")).alias(f"y{k}") for k in range(max_degree + 1)], F.sum(F.col("y") * F.col("y")).alias("yy")).first()

        def r2(degree: int, sums=sums) -> float:
            a = np.array([[sums[f"x{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
            b = np.array([sums[f"y{i}"] for i in range(degree + 1)])
            total = sums.yy - sums.y0**2 / sums.x0
            return 1 - (sums.yy - float(np.linalg.lstsq(a, b, rcond=None)[0] @ b)) / total if total > 0 else 0.0

        fits = [0.0, *[r2(d) for d in range(1, max_degree + 1)]]
        if max_degree >= 2 and fits[1] < linearity and fits[2] > fits[1] + 0.05:
            found.append(Polynomial(c, 2, fits[2] - fits[1], f"R squared {fits[1]:.3f} to {fits[2]:.3f}"))
            if max_degree >= 3 and fits[3] > fits[2] + 0.03:
                found.append(Polynomial(c, 3, fits[3] - fits[1], f"R squared {fits[1]:.3f} to {fits[3]:.3f}"))
    return sorted(found, key=lambda p: (-p.score, p.feature, p.degree))[:most]


def suggest_bins(n: int, low: float, high: float, q1: float, q3: float, std: float) -> int:
    """Median of Sturges, Freedman-Diaconis and Scott, within 3 and 20."""
    if n < 2 or high <= low:
        return 3
    rules = [math.ceil(math.log2(n) + 1)]
    rules += [math.ceil((high - low) / w) for w in (2 * (q3 - q1) / n ** (1 / 3), 3.5 * std / n ** (1 / 3)) if w > 0]
    return int(min(20, max(3, sorted(rules)[len(rules) // 2])))


def recommend_binning(df: DataFrame, columns: list[str] | None = None, most: int = 10, least_unique: int = 20) -> list[Binning]:
    df = normalize(df)
    columns = columns or numeric_columns(df)
    fields = {"n": lambda c: F.count(number(c)), "u": lambda c: F.approx_count_distinct(number(c)), "std": lambda c: F.stddev_samp(number(c)), "skew": lambda c: F.skewness(number(c))}
    out = []
    found = [r for r in long_form(df, columns, "c", fields).collect() if r.u >= least_unique]
    for r, q in zip(found, exact_quantiles(df, [number(r.c) for r in found], (0.0, 0.25, 0.75, 1.0)) if found else [], strict=True):
        n_bins = suggest_bins(r.n, q[0], q[3], q[1], q[2], r.std or 0.0)
        strategy = "uniform" if abs(r["skew"] or 0.0) < 0.5 else "quantile"
        if strategy == "uniform":
            edges = [q[0] + (q[3] - q[0]) * i / n_bins for i in range(n_bins + 1)]
        else:
            edges = exact_quantiles(df, [number(r.c)], tuple(i / n_bins for i in range(n_bins + 1)))[0]
        edges = sorted(set(edges))  # ties leave fewer, distinct edges
        out.append(Binning(r.c, strategy, len(edges) - 1, edges, [f"bin_{i}" for i in range(len(edges) - 1)]))
    return out[:most]


def bin_column(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins, the lowest edge included; null outside."""
    found = F.when((c >= edges[0]) & (c <= edges[1]), labels[0])
    for low, high, label in zip(edges[1:-1], edges[2:], labels[1:], strict=True):
        found = found.when((c > low) & (c <= high), label)
    return found


def apply_binning(df: DataFrame, chosen: list[Binning]) -> DataFrame:
    return df.withColumns({f"{b.feature}_binned": bin_column(number(b.feature), b.edges, b.labels) for b in chosen})


def encoding_rules(df: DataFrame, target: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Per string column its distinct values and the encoding that suits them."""
    columns = [c for c in columns or categorical_columns(df) if c != target]
    rows = long_form(df, columns, "column_name", {"n_unique": lambda c: F.count_distinct(col(c))})
    u, wide = F.col("n_unique"), "target" if target else "frequency"
    return rows.withColumn("encoding", F.when(u == 2, "label").when(u <= 10, "one_hot").otherwise(wide))


def recommend_encoding(df: DataFrame, target: str | None = None) -> list[Recommendation]:
    others = {"label": ["one_hot"], "one_hot": ["label"], "target": ["frequency", "binary"], "frequency": ["target", "binary"]}
    return [Recommendation(r.column_name, r.encoding, f"{r.n_unique} distinct values", others[r.encoding]) for r in encoding_rules(df, target).collect()]


def scaling_rules(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column the first scaling rule that holds."""
    df = normalize(df)
    fields = {"n": lambda c: F.count(number(c)), "mean": lambda c: F.avg(number(c)), "std": lambda c: F.stddev_samp(number(c)), "min": lambda c: F.min(number(c)), "max": lambda c: F.max(number(c)), "skew": lambda c: F.skewness(number(c))}
    from .outliers import outliers

    columns = columns or numeric_columns(df)
    rows = long_form(df, columns, "column_name", fields).join(F.broadcast(outliers(df, "iqr", columns=columns).select("column_name", "percentage")), "column_name")
    s = F.coalesce(F.abs("skew"), F.lit(0.0))
    choice = (
        F.when(F.col("n") == 0, "none").when((F.abs("mean") < 0.1) & (F.abs(F.col("std") - 1) < 0.1), "none").when((F.col("min") >= 0) & (F.col("max") <= 1), "none")
        .when((s > 2) & (F.col("min") > 0), "log").when(s > 2, "robust").when(F.col("percentage") > 5, "robust").otherwise("standard")
    )
    return rows.select("column_name", choice.alias("scaling"))


def scaled(df: DataFrame, column: str, how: str) -> DataFrame:
    """df with {column}_scaled."""
    v = number(column)
    if how in ("log", "sqrt", "none"):
        return df.withColumn(f"{column}_scaled", {"log": F.ln(F.when(v > 0, v)), "sqrt": F.sqrt(F.when(v >= 0, v)), "none": v}[how])
    if how == "robust":
        stats = quantile_row(df, [column], (0.25, 0.5, 0.75)).select(F.col("q0")[1].alias("_a"), (F.col("q0")[2] - F.col("q0")[0]).alias("_b"))
    elif how == "minmax":
        stats = df.agg(F.min(v).alias("_a"), (F.max(v) - F.min(v)).alias("_b"))
    elif how == "standard":
        stats = df.agg(F.avg(v).alias("_a"), F.stddev_pop(v).alias("_b"))
    else:
        raise ValueError(f"unknown scaling {how!r}")
    return df.crossJoin(F.broadcast(stats)).withColumn(f"{column}_scaled", F.try_divide(v - F.col("_a"), "_b")).drop("_a", "_b")  # one row


def encoded(df: DataFrame, column: str, how: str, target: str | None = None) -> DataFrame:
    """df with the encoding's columns; levels are a broadcast table behind Spark's own size check."""
    levels = df.where(col(column).isNotNull()).groupBy(col(column).alias("_l")).agg(F.count(F.lit(1)).alias("_n"), *([F.avg(number(target)).alias("_t")] if target else []))
    if how == "one_hot":
        names = [r[0] for r in levels.orderBy("_l").limit(100).select("_l").collect()]
        return df.withColumns({f"{column}_{n}": (col(column) == n).cast("int") for n in names})
    if how == "label":
        levels = levels.withColumn("_v", F.row_number().over(Window.orderBy("_l")) - 1)
    elif how == "frequency":
        levels = levels.withColumn("_v", F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(0))))
    elif how == "target" and target:
        levels = levels.withColumn("_v", F.col("_t"))
    elif how == "binary":
        levels = levels.withColumn("_v", F.bin(F.row_number().over(Window.orderBy("_l")) - 1))
    else:
        raise ValueError(f"unknown encoding {how!r}")
    return df.join(levels.select("_l", F.col("_v").alias(f"{column}_{how}")), col(column) == F.col("_l"), "left").drop("_l")


def analyze(df: DataFrame, target: str | None = None) -> dict:
    return {
        "interactions": detect_interactions(df, target), "polynomials": detect_polynomials(df, target if target in numeric_columns(df) else None), "binning": recommend_binning(df, [c for c in numeric_columns(df) if c != target]),
        "encoding": recommend_encoding(df, target), "scaling": [Recommendation(r.column_name, r.scaling, "by its range, shape and outliers") for r in scaling_rules(df).collect()],
    }


def generate_code(found: dict, n_top: int = 5) -> str:
    """PySpark source that adds the first recommendations of each kind to a DataFrame df."""
    lines = ["from pyspark.ml.feature import OneHotEncoder, RobustScaler, StandardScaler, StringIndexer, VectorAssembler", "from pyspark.sql import functions as F", ""]
    signs = {"multiply": "*", "add": "+", "subtract": "-"}
    for c in found.get("interactions", [])[:n_top]:
        body = f"F.try_divide(F.col({c.feature1!r}), F.col({c.feature2!r}))" if c.operation == "divide" else f"F.col({c.feature1!r}) {signs[c.operation]} F.col({c.feature2!r})"
        lines.append(f"df = df.withColumn({f'{c.feature1}_{c.operation}_{c.feature2}'!r}, {body})")
    for p in found.get("polynomials", [])[:n_top]:
        lines.append(f"df = df.withColumn({f'{p.feature}_pow{p.degree}'!r}, F.pow({p.feature!r}, F.lit({p.degree})))")
    for b in found.get("binning", [])[:n_top]:
        cases = "".join(f".when(F.col({b.feature!r}) <= {e!r}, {label!r})" for e, label in zip(b.edges[1:], b.labels, strict=True))
        lines.append(f"df = df.withColumn({f'{b.feature}_binned'!r}, F{cases})")
    for r in found.get("encoding", [])[:n_top]:
        lines.append(f"df = StringIndexer(inputCol={r.feature!r}, outputCol={f'{r.feature}_index'!r}).fit(df).transform(df)")
        if r.choice == "one_hot":
            lines.append(f"df = OneHotEncoder(inputCol={f'{r.feature}_index'!r}, outputCol={f'{r.feature}_vector'!r}).fit(df).transform(df)")
    for r in found.get("scaling", [])[:n_top]:
        if r.choice == "log":
            lines.append(f"df = df.withColumn({f'{r.feature}_scaled'!r}, F.ln({r.feature!r}))")
        elif r.choice in ("standard", "robust"):
            lines.append(f"df = VectorAssembler(inputCols=[{r.feature!r}], outputCol={f'{r.feature}_v'!r}).transform(df)")
            lines.append(f"df = {'StandardScaler' if r.choice == 'standard' else 'RobustScaler'}(inputCol={f'{r.feature}_v'!r}, outputCol={f'{r.feature}_scaled'!r}).fit(df).transform(df)")
    return "\n".join(lines) + "\n"


