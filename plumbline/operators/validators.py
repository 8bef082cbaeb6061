"""Validation rules; all rules that count rows run as one aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import categorical_columns, col, datetime_columns, normalize, number, numeric_columns, quoted

Rule = tuple[str, str, dict]


def violation(column: str, kind: str, options: dict) -> Column:
    """Whether a row breaks a row rule; nulls break not_null only, unless allow_null is false."""
    c, v = col(column), number(column)
    if kind == "not_null":
        return c.isNull()
    if kind == "range":
        bad = F.lit(False)
        if options.get("min_value") is not None:
            bad |= v < options["min_value"]
        if options.get("max_value") is not None:
            bad |= v > options["max_value"]
    elif kind == "allowed":
        bad = ~c.isin(options["values"])
    elif kind == "pattern":
        bad = ~c.cast("string").rlike(f"^(?:{options['pattern']})")
    elif kind == "length":
        n = F.length(c.cast("string"))
        bad = (n < options.get("min_length", 0)) | (n > options.get("max_length", 2**31 - 1))
    elif kind == "finite":
        bad = F.abs(v) == float("inf")
    else:
        raise ValueError(f"unknown rule {kind!r}")
    return F.coalesce(bad, F.lit(False)) | (c.isNull() & F.lit(not options.get("allow_null", True)))


def check_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(column_name, rule, violations) in one job; unique counts rows beyond the first of each value, nulls as one value."""
    df = normalize(df)

    def counted(column: str, kind: str, options: dict) -> Column:
        if kind == "unique":
            return F.count(F.lit(1)) - F.count_distinct(col(column)) - F.coalesce(F.max(col(column).isNull().cast("int")), F.lit(0))
        return F.count_if(violation(column, kind, options))

    one = df.agg(*[counted(*r).cast("long").alias(f"r{i}") for i, r in enumerate(rules)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("rule"), F.col(f"r{i}").alias("violations")) for i, (c, k, _) in enumerate(rules)])))


def offenders(df: DataFrame, rule: Rule, limit: int = 10) -> list:
    """Up to limit distinct values that break a row rule."""
    return [r[0] for r in normalize(df).where(violation(*rule)).select(col(rule[0])).distinct().orderBy(quoted(rule[0])).limit(limit).collect()]


def missing_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def wrong_type(df: DataFrame, columns: list[str], kind: str) -> list[str]:
    """Columns of the list that aren't of the class numeric, categorical (or string) or datetime."""
    good = {"numeric": numeric_columns, "categorical": categorical_columns, "string": categorical_columns, "datetime": datetime_columns}[kind](df)
    return [c for c in columns if c not in good]


def validate_table(df: DataFrame, min_rows: int | None = None, min_columns: int | None = None, max_missing_rate: float | None = None) -> tuple[bool, list[str]]:
    df = normalize(df)
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    errors = [] if r.n else ["the table is empty"]
    if min_rows is not None and r.n < min_rows:
        errors.append(f"{r.n} rows, fewer than {min_rows}")
    if min_columns is not None and len(df.columns) < min_columns:
        errors.append(f"{len(df.columns)} columns, fewer than {min_columns}")
    rate = sum(r[f"m{i}"] for i in range(len(df.columns))) / (r.n * len(df.columns)) if r.n and df.columns else 0.0
    if max_missing_rate is not None and rate > max_missing_rate:
        errors.append(f"missing rate {rate:.4f}, above {max_missing_rate}")
    return not errors, errors


def duplicate_count(df: DataFrame, subset: list[str] | None = None, keep: str = "first") -> int:
    """Rows beyond one of each group (keep first or last), or all rows of repeated groups (keep none)."""
    names = [quoted(c) for c in subset or df.columns]
    counts = normalize(df).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") if keep == "none" else F.col("_n") - 1)), F.lit(0)).alias("d")).first().d


def validate_schema(df: DataFrame, schema: dict[str, dict], strict: bool = True) -> tuple[bool, list[str]]:
    """Checks {column: {type, required, nullable, min_value, max_value, allowed_values, pattern, min_length, max_length}} in one job."""
    errors = [f"{c}: required column is absent" for c, s in schema.items() if c not in df.columns and s.get("required", True)]
    if strict:
        errors += [f"{c}: unexpected column" for c in df.columns if c not in schema]
    rules: list[Rule] = []
    for c, s in schema.items():
        if c not in df.columns:
            continue
        if "type" in s and wrong_type(df, [c], s["type"]):
            errors.append(f"{c}: is not {s['type']}")
            continue
        if not s.get("nullable", True):
            rules.append((c, "not_null", {}))
        if "min_value" in s or "max_value" in s:
            rules.append((c, "range", s))
        if "allowed_values" in s:
            rules.append((c, "allowed", {"values": s["allowed_values"]}))
        if "pattern" in s:
            rules.append((c, "pattern", s))
        if "min_length" in s or "max_length" in s:
            rules.append((c, "length", {k: s[k] for k in ("min_length", "max_length") if k in s}))
    if rules:
        errors += [f"{r.column_name}: {r.violations} rows break {r.rule}" for r in check_rules(df, rules).collect() if r.violations]
    return not errors, errors


def validate_custom(df: DataFrame, check: Callable[[DataFrame], tuple[bool, list[str]]], description: str = "custom validation") -> tuple[bool, list[str]]:
    try:
        return check(df)
    except Exception as error:  # a user's function may raise anything; that is a failed check
        return False, [f"{description}: {error}"]


def validate_all(df: DataFrame, checks: list[tuple[Callable, dict, str]]) -> dict:
    results = {}
    for check, options, description in checks:
        good, errors = validate_custom(df, lambda d, check=check, options=options: check(d, **options), description)
        results[description] = {"valid": good, "errors": errors}
    passed = sum(r["valid"] for r in results.values())
    return {"valid": passed == len(results), "passed": passed, "failed": len(results) - passed, "results": results}
