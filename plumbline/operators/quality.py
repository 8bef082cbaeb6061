"""Data-quality profile: missing values, duplicates, type suggestions, consistency, cardinality and the weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import categorical_columns, col, long_form, normalize, number, numeric_columns, quoted

WEIGHTS = {"completeness": 0.35, "uniqueness": 0.25, "consistency": 0.20, "validity": 0.20}
#: Name parts of columns in which a negative number is unexpected.
NON_NEGATIVE = ("age", "count", "price", "amount", "quantity")
NUMERIC_TEXT = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy-MM-dd'T'HH:mm:ss")
SPACE_AROUND = r"(?U)^\s|\s$"


def missing(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Missing count and rate in per cent per column, and whether the rate is above the threshold."""
    df = normalize(df)
    rows = long_form(df, df.columns, "column_name", {"missing": lambda c: F.count_if(col(c).isNull()), "rows": lambda c: F.count(F.lit(1))})
    rate = F.coalesce(100 * F.try_divide(F.col("missing").cast("double"), "rows"), F.lit(0.0))
    return rows.select("column_name", "missing", rate.alias("missing_rate"), (F.col("missing") > 0).alias("has_missing"), (rate > threshold * 100).alias("above_threshold"))


def missing_rows(df: DataFrame, column: str, key: list[str], limit: int = 100) -> DataFrame:
    """The first keys at which the column is missing."""
    return normalize(df).where(col(column).isNull()).select(*key).orderBy(*key).limit(limit)


def row_completeness(df: DataFrame) -> DataFrame:
    """One row: rows with all or any values missing, and the spread of rows' completeness in per cent."""
    df = normalize(df)
    present = sum((col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    share = 100.0 * present / len(df.columns)
    return df.select(present.alias("p"), share.alias("s")).agg(
        F.count_if(F.col("p") == 0).alias("rows_all_missing"), F.count_if(F.col("p") < len(df.columns)).alias("rows_any_missing"), F.avg("s").alias("mean_completeness"),
        F.min("s").alias("min_completeness"), F.max("s").alias("max_completeness"), F.stddev_samp("s").alias("std_completeness"),
    )


def duplicate_groups(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows that occur more than once (nulls equal nulls) with their number; partial counts are combined before the shuffle."""
    names = [quoted(c) for c in subset or df.columns]
    return normalize(df).groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """One row: rows in all, all members of duplicate groups, groups, distinct rows, duplicate rate in per cent."""
    names = [quoted(c) for c in subset or df.columns]
    counts = normalize(df).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    total, members = F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0))
    return counts.agg(total.alias("rows"), members.alias("duplicate_rows"), F.count_if(F.col("_n") > 1).alias("duplicate_groups"), F.count(F.lit(1)).alias("unique_rows"), F.coalesce(100 * F.try_divide(members.cast("double"), total), F.lit(0.0)).alias("duplicate_rate"))


def column_duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: values that repeat an earlier one (nulls repeat nulls) and distinct non-null values."""
    df = normalize(df)
    rows = long_form(df, columns or df.columns, "column_name", {"rows": lambda c: F.count(F.lit(1)), "n_unique": lambda c: F.count_distinct(col(c)), "any_null": lambda c: F.max(col(c).isNull().cast("int"))})
    return rows.select("column_name", (F.col("rows") - F.col("n_unique") - F.coalesce("any_null", F.lit(0))).cast("long").alias("duplicates"), "n_unique")


def parses_as_date(c: Column) -> Column:
    found = F.lit(None).cast("timestamp")
    for fmt in DATE_FORMATS:
        found = F.coalesce(found, F.try_to_timestamp(c, F.lit(fmt)))
    return found.isNotNull()


def type_suggestions(df: DataFrame) -> DataFrame:
    """Per numeric or string column what it may rather be: one row per suggestion."""
    df = normalize(df)
    texts, numbers = categorical_columns(df), numeric_columns(df)
    fields = {"rows": lambda c: F.count(F.lit(1)), "present": lambda c: F.count(col(c)), "n_unique": lambda c: F.count_distinct(col(c))}
    parsing = {
        "numeric": lambda c: F.count_if(col(c).isNotNull() & ~col(c).rlike(NUMERIC_TEXT)) if c in texts else F.lit(1).cast("long"),
        "dates": lambda c: F.count_if(col(c).isNotNull() & ~F.coalesce(parses_as_date(col(c)), F.lit(False))) if c in texts else F.lit(1).cast("long"),
    }
    rows = long_form(df, numbers + texts, "column_name", fields | {k: (lambda f: lambda c: F.max(f(c)) if c not in texts else f(c))(f) for k, f in parsing.items()})
    is_text, u, n = F.col("column_name").isin(texts) if texts else F.lit(False), F.col("n_unique"), F.col("rows")
    rules = [
        F.when(~is_text & (u < 10) & (n > 20), "category"), F.when(is_text & (F.col("present") > 0) & (F.col("numeric") == 0), "numeric"),
        F.when(is_text & (F.col("present") > 0) & (F.col("numeric") > 0) & (F.col("dates") == 0), "datetime"), F.when(is_text & (u < 0.5 * n) & (u < 100), "category"),
    ]
    return rows.select("column_name", F.explode(F.filter(F.array(*rules), lambda s: s.isNotNull())).alias("suggestion"))


def numeric_checks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Infinite, negative and zero values per numeric column, and whether negatives are unexpected by the column's name."""
    df = normalize(df)
    rows = long_form(
        df, columns or numeric_columns(df), "column_name",
        {"infinite": lambda c: F.count_if(F.abs(number(c)) == float("inf")), "negative": lambda c: F.count_if(number(c) < 0), "zero": lambda c: F.count_if(number(c) == 0)},
    )
    named = F.exists(F.array(*[F.lit(w) for w in NON_NEGATIVE]), lambda w: F.contains(F.lower("column_name"), w))
    return rows.withColumn("unexpected_negative", named & (F.col("negative") > 0))


def text_checks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Space around values, empty strings, values that differ only in case, and lengths, per string column."""
    lower = lambda c: F.count_distinct(F.lower(col(c)))
    rows = long_form(
        df, columns or categorical_columns(df), "column_name",
        {"space_around": lambda c: F.count_if(col(c).rlike(SPACE_AROUND)), "empty": lambda c: F.count_if(col(c) == ""), "n_unique": lambda c: F.count_distinct(col(c)), "n_unique_lower": lower,
         "min_length": lambda c: F.min(F.length(col(c))).cast("long"), "max_length": lambda c: F.max(F.length(col(c))).cast("long"), "avg_length": lambda c: F.avg(F.length(col(c)))},
    )
    return rows.withColumn("case_inconsistent", F.col("n_unique") != F.col("n_unique_lower"))


def consistency_issues(df: DataFrame) -> DataFrame:
    """One row per issue with its severity, worst first."""
    issues = []
    if numeric_columns(df):
        n = numeric_checks(df)
        issues += [n.where("infinite > 0").select("column_name", F.lit("infinite_values").alias("issue"), F.lit("high").alias("severity"), F.col("infinite").alias("n")), n.where("unexpected_negative").select("column_name", F.lit("unexpected_negative"), F.lit("medium"), "negative")]
    if categorical_columns(df):
        t = text_checks(df)
        issues += [t.where("space_around > 0").select("column_name", F.lit("space_around"), F.lit("low"), "space_around"), t.where("empty > 0").select("column_name", F.lit("empty_strings"), F.lit("medium"), "empty"), t.where("case_inconsistent").select("column_name", F.lit("case_inconsistent"), F.lit("low"), F.col("n_unique") - F.col("n_unique_lower"))]
    out = issues[0] if issues else df.sparkSession.createDataFrame([], "column_name string, issue string, severity string, n long")
    for other in issues[1:]:
        out = out.union(other)
    return out.orderBy(F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2), "column_name", "issue")


def cardinality(df: DataFrame, columns: list[str] | None = None, high: int = 50) -> DataFrame:
    """Distinct values per column and their class, tested in the order constant, unique, low, high, medium."""
    df = normalize(df)
    rows = long_form(df, columns or df.columns, "column_name", {"rows": lambda c: F.count(F.lit(1)), "n_unique": lambda c: F.count_distinct(col(c))})
    u = F.col("n_unique")
    level = F.when(u == 1, "constant").when(u == F.col("rows"), "unique").when(u <= 10, "low").when(u > high, "high").otherwise("medium")
    return rows.select("column_name", "n_unique", F.coalesce(100 * F.try_divide(u.cast("double"), "rows"), F.lit(0.0)).alias("unique_rate"), (u == F.col("rows")).alias("is_unique"), level.alias("level"))


def quality_level(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").when(score >= 40, "poor").otherwise("critical")


def quality_score(df: DataFrame) -> DataFrame:
    """One row: the four components in per cent, their weighted sum and its level."""
    k = len(df.columns)
    lost = missing(df).agg(F.sum("missing").alias("missing_cells"))
    rows = duplicates(df).select("rows", "unique_rows")
    issues = consistency_issues(df).agg(F.count(F.lit(1)).alias("issues"))
    hints = type_suggestions(df).agg(F.count(F.lit(1)).alias("suggestions"))
    one = lost.crossJoin(rows).crossJoin(issues).crossJoin(hints)  # one row each
    parts = {
        "completeness": 100 * (1 - F.coalesce(F.try_divide(F.col("missing_cells").cast("double"), F.col("rows") * k), F.lit(0.0))),
        "uniqueness": 100 * F.coalesce(F.try_divide(F.col("unique_rows").cast("double"), "rows"), F.lit(1.0)),
        "consistency": 100 * F.greatest(F.lit(0.0), 1 - F.col("issues") / (3.0 * k)), "validity": 100 * F.greatest(F.lit(0.0), 1 - F.col("suggestions") / float(k)),
    }
    scored = one.withColumns(parts)
    total = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    return scored.select(*parts, total.alias("overall_score"), quality_level(total).alias("level"))


def missing_recommendation(rate: float, columns_above: int) -> str:
    if rate == 0:
        return "No missing values."
    if rate < 5:
        return "Few missing values: impute them or drop the rows."
    if rate < 20:
        return f"A moderate share is missing; look at the {columns_above} columns above the threshold before imputing."
    return f"A large share is missing; consider dropping the {columns_above} columns above the threshold."


def duplicate_recommendation(rate: float) -> str:
    if rate == 0:
        return "No duplicate rows."
    if rate < 5:
        return "Few duplicate rows: drop them."
    return "Some rows repeat; find out why before dropping them." if rate < 20 else "Many rows repeat; check how the data were gathered."


