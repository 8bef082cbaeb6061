"""Descriptive, distributional and categorical profiles as fused aggregates in long form."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import categorical_columns, col, datetime_columns, long_form, normalize, number, numeric_columns, quoted
from ..functions.special import t_ppf
from .quantiles import quantile_row, ranged_quantiles, sketch, value_cells

PERCENTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def adjusted_skewness(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def adjusted_kurtosis(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(c) + 6))


def moments(df: DataFrame, columns: list[str] | None = None, **more: Callable[[str], Column]) -> DataFrame:
    """One row per numeric column with counts, moments, extremes and shape, from one fused aggregate."""
    df = normalize(df)
    return long_form(
        df, columns or numeric_columns(df), "column_name",
        {
            "count": lambda c: F.count(number(c)), "missing": lambda c: F.count_if(col(c).isNull()), "mean": lambda c: F.avg(number(c)),
            "std": lambda c: F.stddev_samp(number(c)), "variance": lambda c: F.var_samp(number(c)), "min": lambda c: F.min(number(c)), "max": lambda c: F.max(number(c)),
            "skewness": lambda c: adjusted_skewness(number(c)), "kurtosis": lambda c: adjusted_kurtosis(number(c)), **more,
        },
    )


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, mode): the most frequent value, the least of them on ties; values are counted where they are dealt to by value."""
    df = normalize(df)
    counts = df.select(value_cells({i: number(c) for i, c in enumerate(columns)})).where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("c").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"))
    return found.select(F.array(*[F.lit(c) for c in columns])[F.col("c")].alias("column_name"), "mode")


def describe_numeric(df: DataFrame, columns: list[str] | None = None, accuracy: str = "exact") -> DataFrame:
    """One row per numeric column with its moments, order statistics and shape.

    accuracy of the percentiles: exact or ranged (the same: exact at any size), approx (a sketch).
    """
    df = normalize(df)
    columns = columns or numeric_columns(df)
    rows = moments(df, columns, **({"q": lambda c: sketch(number(c), PERCENTILES)} if accuracy == "approx" else {}))
    if accuracy != "approx":
        rows = rows.join(F.broadcast(ranged_quantiles(df, columns, PERCENTILES)), "column_name")  # a row per column
    rows = rows.join(F.broadcast(modes(df, columns)), "column_name", "left")  # a row per column
    named = {n: F.col("q")[i] for i, n in enumerate(("p05", "p10", "q1", "median", "q3", "p90", "p95"))}
    rows = rows.withColumns(named).select("column_name", "count", "missing", "mean", "mode", "std", "variance", "min", "max", "skewness", "kurtosis", *named)
    return rows.withColumns({"range": F.col("max") - F.col("min"), "iqr": F.col("q3") - F.col("q1"), "cv": 100 * F.try_divide("std", "mean")})


def mean_interval(description: DataFrame, confidence: float = 0.95) -> list[dict]:
    """Student-t intervals of the means, on the driver from the description's rows (one per column)."""
    out = []
    for r in description.select("column_name", "count", "mean", "std").collect():
        half = t_ppf((1 + confidence) / 2, r["count"] - 1) * r["std"] / math.sqrt(r["count"]) if r["count"] > 1 else None
        out.append({"column_name": r["column_name"], "lower": None if half is None else r["mean"] - half, "upper": None if half is None else r["mean"] + half})
    return out


def median_deviation(df: DataFrame, columns: list[str] | None = None, accuracy: str = "exact") -> DataFrame:
    """Median absolute deviation per column: the medians come from one job, the deviations from a second."""
    df = normalize(df)
    columns = columns or numeric_columns(df)
    medians = quantile_row(df, columns, (0.5,), accuracy).select(*[F.col(f"q{i}")[0].alias(f"_m{i}") for i in range(len(columns))])
    joined = df.select(*[number(c).alias(f"_v{i}") for i, c in enumerate(columns)]).crossJoin(F.broadcast(medians))  # one row
    away = joined.select(*[F.abs(F.col(f"_v{i}") - F.col(f"_m{i}")).alias(f"_d{i}") for i in range(len(columns))])
    deviations = quantile_row(away, [f"_d{i}" for i in range(len(columns))], (0.5,), accuracy).select(*[F.col(f"q{i}")[0].alias(f"d{i}") for i in range(len(columns))])
    one = medians.select(*[F.col(f"_m{i}").alias(f"m{i}") for i in range(len(columns))]).crossJoin(F.broadcast(deviations))  # one row each
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("median"), F.col(f"d{i}").alias("mad")) for i, c in enumerate(columns)])))


def interpret_skewness(s: Column) -> Column:
    size = F.abs(F.coalesce(s, F.lit(0.0)))
    return F.when(size < 0.5, "symmetric").when(size < 1, "moderately skewed").when(s > 0, "highly right-skewed").otherwise("highly left-skewed")


def interpret_kurtosis(k: Column) -> Column:
    k = F.coalesce(k, F.lit(0.0))
    return F.when(k < -1, "platykurtic").when(k > 1, "leptokurtic").otherwise("mesokurtic")


def classify_distribution(s: Column, k: Column) -> Column:
    s, k = F.coalesce(s, F.lit(0.0)), F.coalesce(k, F.lit(0.0))
    return F.when((F.abs(s) < 0.5) & (F.abs(k) < 0.5), "normal").when(F.abs(s) < 0.5, "symmetric_non_normal").when(s > 0, "right_skewed").otherwise("left_skewed")


def distributions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values, discreteness (fewer than 20 of them) and shape per numeric column."""
    df = normalize(df)
    rows = long_form(
        df, columns or numeric_columns(df), "column_name",
        {"n_unique": lambda c: F.count_distinct(number(c)), "skewness": lambda c: adjusted_skewness(number(c)), "kurtosis": lambda c: adjusted_kurtosis(number(c))},
    )
    s, k = F.col("skewness"), F.col("kurtosis")
    return rows.withColumns({"is_discrete": F.col("n_unique") < 20, "skewness_type": interpret_skewness(s), "kurtosis_type": interpret_kurtosis(k), "distribution": classify_distribution(s, k)})


def melt(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value as string) of the columns, narrow, for one grouping job over all of them."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs))


def value_counts(df: DataFrame, columns: list[str], top: int | None = 10) -> DataFrame:
    """Counts of non-null values per column, most frequent first, ties by value; partial counts are combined before the shuffle."""
    counts = melt(df, columns).where("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value")).cast("long"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def categorical_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, missing, unique, mode with its share, entropy in bits against its maximum, per string column."""
    columns = columns or categorical_columns(df)
    counts = melt(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column_name").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("count"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("n_unique"), F.max_by("value", F.struct(F.when(F.col("value").isNotNull(), F.col("n")), F.lit(1))).alias("any_mode"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("mode_count"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n") * F.log2("n"))).alias("n_log_n"),
    ).drop("any_mode")
    modes = counts.where("value is not null").join(F.broadcast(totals.select("column_name", "mode_count")), "column_name").where("n = mode_count").groupBy("column_name").agg(F.min("value").alias("mode"))
    entropy = F.log2("count") - F.col("n_log_n") / F.col("count")
    highest = F.log2(F.col("n_unique").cast("double"))
    rows = totals.join(F.broadcast(modes), "column_name", "left").withColumns({"entropy": F.abs(F.when(F.col("count") > 0, entropy)), "max_entropy": highest})
    return rows.select(
        "column_name", "count", "missing", "n_unique", "mode", "mode_count", (100 * F.try_divide("mode_count", "count")).alias("mode_percentage"), "entropy", "max_entropy",
        F.coalesce(F.try_divide("entropy", "max_entropy"), F.lit(0.0)).alias("diversity"),
    )


def streaming_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The mergeable chunk statistics: count, mean, population deviation, min, max, missing."""
    df = normalize(df)
    return long_form(
        df, columns or numeric_columns(df), "column_name",
        {"count": lambda c: F.count(number(c)), "mean": lambda c: F.avg(number(c)), "std": lambda c: F.stddev_pop(number(c)), "min": lambda c: F.min(number(c)), "max": lambda c: F.max(number(c)), "missing": lambda c: F.count_if(col(c).isNull())},
    )


def overview(df: DataFrame) -> DataFrame:
    """One row: shape, columns by class, rows that repeat an earlier one."""
    n, names = len(df.columns), [quoted(c) for c in df.columns]
    groups = normalize(df).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0))
    counted = [len(numeric_columns(df)), len(categorical_columns(df)), len(datetime_columns(df))]
    return groups.agg(
        total.alias("rows"), F.lit(n).cast("long").alias("columns"), *[F.lit(k).cast("long").alias(c) for k, c in zip((*counted, n - sum(counted)), ("numeric_columns", "categorical_columns", "datetime_columns", "other_columns"), strict=True)],
        (total - F.count(F.lit(1))).alias("duplicate_rows"),
    )


def grouped_distribution(df: DataFrame, value: str, group: str) -> DataFrame:
    """Per group: size, quartiles and whisker ends, for box and violin charts."""
    rows = normalize(df).where(col(value).isNotNull() & col(group).isNotNull()).groupBy(col(group).alias("group_value"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min(number(value)).alias("min"), F.percentile(number(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(number(value)).alias("max"), F.avg(number(value)).alias("mean")).select(
        "group_value", "n", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max", "mean"
    )


def compare_series(df: DataFrame, series: str, value: str) -> DataFrame:
    """Per series: mean, sample deviation, extremes, median, biased skewness and kurtosis, plain coefficient of variation."""
    v = number(value)
    rows = normalize(df).where(v.isNotNull()).groupBy(col(series).alias("series")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"))
    return rows.withColumn("cv", F.when(F.col("mean") == 0, F.lit(float("inf"))).otherwise(F.try_divide("std", "mean")))


def hierarchy_totals(df: DataFrame, path: list[str], value: str | None = None) -> DataFrame:
    """Rollup over path with each node's total and its share of the parent in per cent."""
    measure = F.sum(number(value)) if value else F.count(F.lit(1)).cast("double")
    rolled = df.rollup(*[quoted(p) for p in path]).agg(measure.alias("total"), F.grouping_id().alias("gid"))
    rolled = rolled.withColumn("level", (len(path) - F.bit_count("gid")).cast("long"))
    child, parent = rolled.alias("c"), rolled.alias("p")
    same = F.col("p.level") == F.col("c.level") - 1
    for i, p in enumerate(path):
        same &= (F.col("p.level") <= i) | F.col(f"c.{quoted(p)}").eqNullSafe(F.col(f"p.{quoted(p)}"))
    joined = child.join(F.broadcast(parent), same, "left")  # the tree is no larger than a chart
    return joined.select(*[F.col(f"c.{quoted(p)}") for p in path], F.col("c.level").alias("level"), F.col("c.total").alias("total"), F.coalesce(100 * F.try_divide(F.col("c.total"), F.col("p.total")), F.lit(100.0)).alias("percent_of_parent"))


def pattern_distances(df: DataFrame, column: str) -> DataFrame:
    """One row: n and the Kolmogorov-Smirnov distances to a uniform and (if all values are positive) an exponential curve fitted by range and mean."""
    from .correlation import average_ranks

    v = normalize(df).select(number(column).alias("v")).where("v is not null")
    facts = v.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"))
    ranks = average_ranks(v, "v", []).crossJoin(F.broadcast(facts))  # one row
    upto, below = (F.col("rank") + (F.col("_ties") - 1) / 2.0) / F.col("n"), (F.col("rank") - (F.col("_ties") + 1) / 2.0) / F.col("n")
    distance = lambda curve: F.max(F.greatest(upto - curve, curve - below))
    uniform = F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo"))
    exponential = F.when(F.col("lo") > 0, 1 - F.exp(-F.try_divide(F.col("v") - F.col("lo"), F.col("mean") - F.col("lo"))))
    return ranks.agg(F.max("n").alias("n"), distance(uniform).alias("d_uniform"), distance(exponential).alias("d_exponential"))


def patterns(df: DataFrame, column: str, bins: int = 20, alpha: float = 0.05) -> dict:
    """Whether the values look uniform or exponential, and how many peaks their histogram has."""
    from ..functions.special import kolmogorov_sf
    from .charts import modes_in_histogram

    r = pattern_distances(df, column).first()
    if not r.n or r.n <= 10:
        return {"uniform_like": False, "exponential_like": False, "modes": 0, "multimodal": False}
    like = lambda d: d is not None and kolmogorov_sf(d, r.n) > alpha
    modes = modes_in_histogram(df, column, bins).count() if r.n > 20 else 0
    return {"uniform_like": like(r.d_uniform), "exponential_like": like(r.d_exponential), "modes": modes, "multimodal": modes > 1}


def compare_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join of two tables' profiles by column: counts, means and deviations of both and the change of the mean."""
    a, b = (streaming_statistics(d).select("column_name", F.col("count").alias(f"count_{s}"), F.col("mean").alias(f"mean_{s}"), F.col("std").alias(f"std_{s}")) for d, s in ((left, "left"), (right, "right")))
    return a.join(b, "column_name", "full_outer").withColumn("mean_change", F.col("mean_right") - F.col("mean_left"))


def estimated_bytes(df: DataFrame) -> DataFrame:
    """(column_name, bytes): fixed widths for numbers and times, UTF-8 lengths for text; one aggregate."""
    widths = {"tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "boolean": 1}
    texts = categorical_columns(df)
    kinds = dict(df.dtypes)
    return long_form(df, df.columns, "column_name", {"bytes": lambda c: F.coalesce(F.sum(F.octet_length(col(c))), F.lit(0)) if c in texts else F.count(F.lit(1)) * widths.get(kinds[c], 8)})
