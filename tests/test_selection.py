"""Quantiles and modes by counting: equal to sorting, bounded in what a task reads, on values that bins don't suit."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import charts, descriptive, features, outliers, quantiles

PLACES = (0.0, 0.05, 0.25, 0.3333, 0.5, 0.75, 0.95, 1.0)


def interpolated(x, p):
    x, place = np.sort(x), (len(x) - 1) * p
    low, high, share = x[math.floor(place)], x[math.ceil(place)], place - math.floor(place)
    return low if share == 0 or low == high else low * (1 - share) + high * share


@pytest.fixture(scope="module")
def odd(spark):
    rng, n = np.random.default_rng(1), 60_000
    return pd.DataFrame({
        "normal": rng.normal(0, 1, n), "few": rng.integers(0, 5, n).astype(float), "wide": np.exp(rng.normal(0, 30, n)) * rng.choice([-1, 1], n), "ends": rng.choice([1e308, -1e308, 5e-324, 0.0, -0.0, 1.0], n),
        "large": 1e15 + rng.integers(0, 50_000, n), "far": np.r_[rng.normal(0, 1e-9, n - 1), 1e300], "same": np.full(n, 7.5),
    })


def test_quantiles_equal_sorting(spark, odd):
    own = quantiles.exact_quantiles(spark.createDataFrame(odd), [F.col(c) for c in odd], PLACES)
    for c, q in zip(odd, own, strict=True):
        np.testing.assert_allclose(q, [interpolated(odd[c].to_numpy(), p) for p in PLACES], rtol=1e-12, err_msg=c)


def test_quantiles_of_missing_and_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in [-inf, -inf, 1.0, 2.0, None, 5.0, inf, inf]], "v double")
    own, none = quantiles.exact_quantiles(df, [F.col("v"), F.lit(None).cast("double")], (0.0, 0.25, 0.4, 0.5, 0.9))
    assert own == [-inf, -inf, pytest.approx(1.4), 2.0, inf] and none is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_buffer_of_distinct_values(spark, odd):
    """percentile and mode hold a column's distinct values in one task."""
    df = spark.createDataFrame(odd.head(500))
    found = [
        descriptive.describe_numeric(df), descriptive.moments(df), descriptive.median_deviation(df, ["normal"]), charts.box(df, ["normal"]), features.scaling_rules(df, ["normal"]), outliers.summary(df, columns=["normal"]),
        *[outliers.outliers(df, m, columns=["normal"]) for m in ("iqr", "modified_zscore")], outliers.score_rows(df, "normal", "modified_zscore"),
    ]
    for own in found:
        assert "percentile(" not in plan(own) and "mode(" not in plan(own)


def test_modes_take_the_least_of_the_most_frequent(spark):
    df = spark.createDataFrame([(2.0, 1), (1.0, 1), (2.0, 5), (1.0, None), (None, 5), (float("nan"), 3)], "a double, b int")
    assert dict(descriptive.modes(df, ["a", "b"]).collect()) == {"a": 1.0, "b": 1.0}


def test_other_uses_of_quantiles(spark, odd):
    df = spark.createDataFrame(odd[["normal"]])
    x = odd["normal"].to_numpy()
    own = charts.qq(df, "normal", 200)
    np.testing.assert_allclose([v for _, v in own], [interpolated(x, (i + 0.5) / 200) for i in range(200)], rtol=1e-12)
    assert "percentile(" not in plan(features.scaled(df, "normal", "robust"))
    q1, q3 = (interpolated(x, p) for p in (0.25, 0.75))
    assert charts.histograms(df)["normal"].count() <= charts.auto_bins(len(x), x.min(), x.max(), q1, q3)
    found = features.recommend_binning(df.selectExpr("exp(normal) AS v"))
    assert found[0].strategy == "quantile" and found[0].edges[0] == pytest.approx(np.exp(x.min())) and found[0].edges[-1] == pytest.approx(np.exp(x.max()))
