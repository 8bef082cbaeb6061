"""Column classes and the one normalisation rule: floating NaN is NULL everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Aggregate expressions that one job computes at most; wider requests run in several jobs.
FUSED = 100


def numeric_columns(df: DataFrame, with_boolean: bool = False) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if with_boolean else (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def column_class(field: T.StructField) -> str:
    if isinstance(field.dataType, T.NumericType):
        return "numeric"
    if isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType)):
        return "categorical"
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "other"


def normalize(df: DataFrame) -> DataFrame:
    """NaN to NULL in floating columns, decimals to double; infinities stay, as they are a quality issue."""
    changed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            changed[f.name] = F.nanvl(F.col(quoted(f.name)), F.lit(None).cast(f.dataType))
        elif isinstance(f.dataType, T.DecimalType):
            changed[f.name] = F.col(quoted(f.name)).cast("double")
    return df.withColumns(changed) if changed else df


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def number(name: str) -> Column:
    return col(name).cast("double")


def long_form(df: DataFrame, columns: list[str], key: str, fields: dict) -> DataFrame:
    """One row per column from one fused aggregate: fields maps an output name to a function of the column's name."""
    parts = []
    width = max(1, FUSED // max(1, len(fields)))
    for at in range(0, len(columns), width):
        some = columns[at : at + width]
        one = df.agg(*[f(c).alias(f"{i}_{n}") for i, c in enumerate(some) for n, f in fields.items()])
        rows = F.array(*[F.struct(F.lit(c).alias(key), *[F.col(f"{i}_{n}").alias(n) for n in fields]) for i, c in enumerate(some)])
        parts.append(one.select(F.inline(rows)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
