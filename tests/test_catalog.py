"""Every registered query runs; those with a SQL twin equal it on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from plumbline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The twin of this one assumes what holds from 0.01 on.
LARGER = {"quality_score", "type_suggestions", "narrow_types"}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    return connection


def rows(frame, columns):
    out = []
    for r in frame[columns].itertuples(index=False):
        out.append(tuple(None if pd.api.types.is_scalar(v) and pd.isna(v) else float(v) if hasattr(v, "real") and not isinstance(v, bool) and type(v).__name__ not in ("bool", "bool_") else str(v) for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, sf, name):
    own = catalog.queries()[name](spark, sf).toPandas()
    if name not in catalog.oracle_sql() or name in LARGER:
        return
    twin = duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(own.columns)
    assert columns == sorted(twin.columns)
    assert rows(own, columns) == rows(twin, columns)
