"""Univariate outlier rules: bounds from one aggregate, one row of bounds broadcast, flags counted in a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, normalize, number, numeric_columns, quoted
from .descriptive import median_deviation
from .quantiles import quantile_row


def _bounds(df: DataFrame, columns: list[str], method: str, limit: float, accuracy: str = "exact") -> DataFrame:
    """One row with low and high of every column (lo_i, hi_i); null where the rule doesn't apply."""
    if method == "iqr":
        one = quantile_row(df, columns, (0.25, 0.75), accuracy)
        spread = lambda i: (F.col(f"q{i}")[1] - F.col(f"q{i}")[0]) * limit
        return one.select(*[e for i in range(len(columns)) for e in ((F.col(f"q{i}")[0] - spread(i)).alias(f"lo_{i}"), (F.col(f"q{i}")[1] + spread(i)).alias(f"hi_{i}"), (F.col(f"q{i}")[1] - F.col(f"q{i}")[0]).alias(f"scale_{i}"))])
    if method == "zscore":
        one = df.agg(*[e for i, c in enumerate(columns) for e in (F.avg(number(c)).alias(f"m{i}"), F.nullif(F.stddev_pop(number(c)), F.lit(0.0)).alias(f"s{i}"))])
        return one.select(*[e for i in range(len(columns)) for e in ((F.col(f"m{i}") - limit * F.col(f"s{i}")).alias(f"lo_{i}"), (F.col(f"m{i}") + limit * F.col(f"s{i}")).alias(f"hi_{i}"), F.col(f"s{i}").alias(f"scale_{i}"))])
    if method == "modified_zscore":
        rows = median_deviation(df, columns, accuracy)
        picked = lambda c, n: F.max(F.when(F.col("column_name") == c, F.col(n)))
        one = rows.agg(*[e for i, c in enumerate(columns) for e in (picked(c, "median").alias(f"m{i}"), F.nullif(picked(c, "mad"), F.lit(0.0)).alias(f"d{i}"))])
        reach = lambda i: limit * F.col(f"d{i}") / 0.6745
        return one.select(*[e for i in range(len(columns)) for e in ((F.col(f"m{i}") - reach(i)).alias(f"lo_{i}"), (F.col(f"m{i}") + reach(i)).alias(f"hi_{i}"), (F.col(f"d{i}") / 0.6745).alias(f"scale_{i}"))])
    raise ValueError(f"unknown method {method!r}; use iqr, zscore or modified_zscore")


LIMITS = {"iqr": 1.5, "zscore": 3.0, "modified_zscore": 3.5}


def outliers(df: DataFrame, method: str = "iqr", limit: float | None = None, columns: list[str] | None = None, accuracy: str = "exact") -> DataFrame:
    """Per column: bounds, values strictly outside (below, above, all) and their share of the non-null values in per cent."""
    df = normalize(df)
    columns = columns or numeric_columns(df)
    bounds = _bounds(df, columns, method, LIMITS[method] if limit is None else limit, accuracy)
    flagged = df.select(*[number(c).alias(f"_v{i}") for i, c in enumerate(columns)]).crossJoin(F.broadcast(bounds))  # one row
    one = flagged.agg(*[
        e for i in range(len(columns)) for e in (
            F.first(f"lo_{i}").alias(f"lo{i}"), F.first(f"hi_{i}").alias(f"hi{i}"), F.count(f"_v{i}").alias(f"n{i}"),
            F.count_if(F.col(f"_v{i}") < F.col(f"lo_{i}")).alias(f"b{i}"), F.count_if(F.col(f"_v{i}") > F.col(f"hi_{i}")).alias(f"a{i}"))
    ])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"lo{i}").alias("lower"), F.col(f"hi{i}").alias("upper"), F.col(f"n{i}").alias("n"), F.col(f"b{i}").alias("below"), F.col(f"a{i}").alias("above")) for i, c in enumerate(columns)])))
    return rows.select("column_name", "lower", "upper", "below", "above", (F.col("below") + F.col("above")).alias("outliers"), F.coalesce(100 * F.try_divide((F.col("below") + F.col("above")).cast("double"), "n"), F.lit(0.0)).alias("percentage"))


def summary(df: DataFrame, methods: tuple[str, ...] = ("iqr", "zscore", "modified_zscore"), columns: list[str] | None = None) -> DataFrame:
    """Per method: outliers in all and columns that have some."""
    parts = [outliers(df, m, columns=columns).select(F.lit(m).alias("method"), "outliers") for m in methods]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("method").agg(F.sum("outliers").alias("total_outliers"), F.count_if(F.col("outliers") > 0).alias("columns_with_outliers"))


def score_rows(df: DataFrame, column: str, method: str = "iqr", limit: float | None = None) -> DataFrame:
    """df with is_anomaly and anomaly_score; null values are no anomalies and score 0.

    iqr: distance beyond the nearer bound; zscore, modified_zscore: absolute score.
    """
    df = normalize(df)
    limit = LIMITS[method] if limit is None else limit
    joined = df.crossJoin(F.broadcast(_bounds(df, [column], method, limit)))  # one row
    v = number(column)
    outside = (v < F.col("lo_0")) | (v > F.col("hi_0"))
    if method == "iqr":
        score: Column = F.greatest(F.col("lo_0") - v, v - F.col("hi_0"), F.lit(0.0))
    else:
        score = F.try_divide(F.abs(v - (F.col("lo_0") + F.col("hi_0")) / 2), F.col("scale_0"))
    return joined.withColumns({"is_anomaly": F.coalesce(outside, F.lit(False)), "anomaly_score": F.coalesce(score, F.lit(0.0))}).drop("lo_0", "hi_0", "scale_0")


def feature_contributions(df: DataFrame, flag: str, columns: list[str], top: int | None = None) -> DataFrame:
    """The flagged rows with contributions: |x - mean| / sample deviation of every feature, largest first."""
    df = normalize(df)
    stats = df.agg(*[e for i, c in enumerate(columns) for e in (F.avg(number(c)).alias(f"_m{i}"), F.nullif(F.stddev_samp(number(c)), F.lit(0.0)).alias(f"_s{i}"))])
    rows = df.where(col(flag)).crossJoin(F.broadcast(stats))  # one row
    parts = F.array(*[F.struct(F.coalesce(F.abs(number(c) - F.col(f"_m{i}")) / F.col(f"_s{i}"), F.lit(0.0)).alias("contribution"), F.lit(c).alias("feature")) for i, c in enumerate(columns)])
    ordered = F.array_sort(parts, lambda a, b: F.when(a["contribution"] > b["contribution"], -1).when(a["contribution"] < b["contribution"], 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    return rows.select(*[quoted(c) for c in df.columns], (F.slice(ordered, 1, top) if top else ordered).alias("contributions"))
