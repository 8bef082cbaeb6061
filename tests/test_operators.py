import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import anomaly, charts, correlation, descriptive, features, hypothesis, outliers, quality, timeseries, validators


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(42)
    n = 200
    x = rng.normal(50, 10, n)
    pdf = pd.DataFrame({"id": range(n), "x": x, "y": 2 * x + rng.normal(0, 1, n), "z": rng.exponential(2, n), "age": rng.integers(20, 60, n).astype(float), "g": rng.choice(["a", "b", "c"], n), "t": [f"w{i}" for i in range(n)]})
    pdf.loc[0, "age"], pdf.loc[1, "age"] = -5.0, math.inf
    pdf.loc[:10, "z"] = np.nan
    return spark.createDataFrame(pdf), pdf


def by(df, key="column_name"):
    return {r[key]: r for r in df.collect()}


def test_description_equals_pandas(mixed):
    df, pdf = mixed
    rows = by(descriptive.describe_numeric(df, ["x", "z"]))
    for c in ("x", "z"):
        v = pdf[c].dropna()
        assert (rows[c]["count"], rows[c].missing) == (len(v), pdf[c].isna().sum())
        assert rows[c]["mean"] == pytest.approx(v.mean())
        assert rows[c]["std"] == pytest.approx(v.std())
        assert rows[c].q1 == pytest.approx(v.quantile(0.25))
        assert rows[c].skewness == pytest.approx(v.skew())
        assert rows[c].kurtosis == pytest.approx(v.kurt())
    assert by(descriptive.median_deviation(df, ["x"]))["x"].mad == pytest.approx((pdf.x - pdf.x.median()).abs().median())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-1000, 1000).map(float)), min_size=1, max_size=40), st.integers(1, 5))
def test_moments_do_not_depend_on_partitions(spark, values, parts):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    one, many = (descriptive.streaming_statistics(d).first() for d in (df.coalesce(1), df.repartition(parts)))
    present = [v for v in values if v is not None]
    assert one["count"] == many["count"] == len(present)
    if present:
        assert many["mean"] == pytest.approx(np.mean(present), abs=1e-9)
        assert many["std"] == pytest.approx(np.std(present), abs=1e-6)


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert by(descriptive.describe_numeric(empty))["a"]["count"] == 0
    assert quality.duplicates(empty).first().rows == 0
    assert quality.quality_score(empty).count() == 1
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, float("nan"))], "a double, b double")
    assert correlation.pearson(constant).count() == 0
    assert by(descriptive.describe_numeric(constant))["b"].missing == 1
    assert by(outliers.outliers(constant, "zscore"))["a"].outliers == 0
    assert descriptive.overview(spark.createDataFrame([(None, 1), (None, 1)], "a string, b int")).first().duplicate_rows == 1


def test_quality(spark, mixed):
    df, _ = mixed
    checks = by(quality.numeric_checks(df))
    assert checks["age"].infinite == 1 and checks["age"].negative == 1 and checks["age"].unexpected_negative
    texts = spark.createDataFrame([(" x", "Test", "1"), ("y", "TEST", "2.5"), ("", "b", None), (" z", "b", "3e1")], "a string, b string, c string")
    t = by(quality.text_checks(texts))
    assert t["a"].space_around == 2 and t["a"].empty == 1 and t["b"].case_inconsistent
    assert ("c", "numeric") in {(r.column_name, r.suggestion) for r in quality.type_suggestions(texts).collect()}
    dates = spark.createDataFrame([("2024-01-02",), ("2024-02-03",)], "d string")
    assert [r.suggestion for r in quality.type_suggestions(dates).collect()] == ["datetime"]
    d = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (None, "b"), (None, "b")], "a int, b string")
    r = quality.duplicates(d).first()
    assert (r.duplicate_rows, r.duplicate_groups, r.unique_rows) == (4, 2, 3)
    assert abs(sum(quality.WEIGHTS.values()) - 1) < 1e-12
    assert [r.severity for r in quality.consistency_issues(df).collect()][:1] == ["high"]


def test_validators(spark):
    df = spark.createDataFrame([(1, "Ann", -5, "a@b"), (1, None, 150, "bad"), (2, "Bob", 30, "c@d")], "id int, name string, age int, email string")
    got = {(r.column_name, r.rule): r.violations for r in validators.check_rules(df, [("id", "unique", {}), ("name", "not_null", {}), ("age", "range", {"min_value": 0, "max_value": 120}), ("email", "pattern", {"pattern": ".+@.+"})]).collect()}
    assert got == {("id", "unique"): 1, ("name", "not_null"): 1, ("age", "range"): 2, ("email", "pattern"): 1}
    assert validators.offenders(df, ("age", "range", {"min_value": 0})) == [-5]
    ok, errors = validators.validate_schema(df, {"id": {"type": "numeric"}, "name": {"nullable": False}, "age": {"min_value": 0}, "email": {"type": "numeric"}})
    assert not ok and len(errors) == 3
    assert validators.duplicate_count(df, ["id"]) == 1 and validators.duplicate_count(df, ["id"], "none") == 2
    assert validators.validate_table(df, min_rows=10)[0] is False
    out = validators.validate_all(df, [(lambda d, n: (d.count() == n, []), {"n": 3}, "three"), (lambda d: 1 / 0, {}, "boom")])
    assert (out["passed"], out["failed"]) == (1, 1)


def test_correlations_equal_pandas(mixed):
    df, pdf = mixed
    for name, f in (("pearson", correlation.pearson), ("spearman", correlation.spearman)):
        got = {(r.feature1, r.feature2): r.r for r in f(df, ["x", "y", "z"]).collect()}
        want = pdf[["x", "y", "z"]].corr(name)
        assert all(v == pytest.approx(want.loc[k[0], k[1]], abs=1e-9) for k, v in got.items()) and len(got) == 3
    v = correlation.vif(df, ["x", "y", "z"])
    assert v[0]["feature"] in ("x", "y") and v[0]["high"]
    same = df.select("x", (F.col("x") * 2).alias("w"))
    assert math.isinf(correlation.vif(same)[0]["vif"])


def test_kendall_against_pairs():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, 40).astype(float), rng.integers(0, 5, 40).astype(float)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(40) for j in range(i))
    ties = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    n0 = 40 * 39 / 2
    cells = pd.DataFrame({"x": x, "y": y}).value_counts().reset_index(name="w")
    assert correlation.kendall_tau_b(cells.x.to_numpy(), cells.y.to_numpy(), cells.w.to_numpy()) == pytest.approx(s / math.sqrt((n0 - ties(x)) * (n0 - ties(y))))


def test_multivariate_anomalies_find_the_odd_row(spark):
    rng = np.random.default_rng(3)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (120, 2)))] + [(500, 9.0, -9.0)]
    df = spark.createDataFrame(points, "id long, a double, b double")
    for name, f in anomaly.METHODS.items():
        top = f(df, ["id"]).orderBy(F.desc("anomaly_score")).first()
        assert top.id == 500 and top.is_anomaly, name
    assert anomaly.ensemble(df, ["id"], ("isolation_forest", "mahalanobis")).where("is_anomaly and id = 500").count() == 1
    flags = outliers.score_rows(df, "a", "zscore").where("is_anomaly")
    assert [r.id for r in flags.collect()] == [500]


def test_hypothesis_tests(spark):
    rows = [("a", float(v)) for v in (5, 6, 7, 8, 9)] + [("b", float(v)) for v in (7, 8, 9, 10, 11)] + [("c", float(v)) for v in (1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "g string, v double")
    a = hypothesis.one_way_anova(df, "v", "g")
    assert a["f"] == pytest.approx(18.6667, rel=1e-4) and a["significant"]
    two = df.where("g != 'c'")
    t = hypothesis.t_test(two, "v", "g")
    assert t["t"] == pytest.approx(-2.0) and t["p_value"] == pytest.approx(0.0805, abs=1e-3)
    assert hypothesis.mann_whitney(two, "v", "g")["u"] == 4.5
    assert hypothesis.kruskal_wallis(df, "v", "g")["p_value"] < 0.05
    assert {(r["group1"], r["group2"]): r["reject"] for r in hypothesis.tukey_hsd(df, "v", "g")} == {("a", "b"): False, ("a", "c"): True, ("b", "c"): True}
    assert hypothesis.holm([0.01, 0.04, 0.03]) == [0.03, 0.06, 0.06] and hypothesis.bonferroni([0.5, 0.01]) == [1.0, 0.02]
    assert hypothesis.levene(df, "v", "g")["equal_variances"] and hypothesis.bartlett(df, "v", "g")["equal_variances"]
    pairs = spark.createDataFrame([("x", "p")] * 3 + [("x", "q")] + [("y", "p")] + [("y", "q")] * 3, "a string, b string")
    assert hypothesis.fisher_exact(pairs, "a", "b")["p_value"] == pytest.approx(0.4857, abs=1e-4)
    assert hypothesis.association(pairs, "a", "b")["test"] == "fisher_exact"
    assert hypothesis.compare_groups(df, "v", "g", parametric=True)["post_hoc"]
    with pytest.raises(hypothesis.TestError):
        hypothesis.one_way_anova(df.where("g = 'a'"), "v", "g")


def test_shapiro_wilk_published_example():
    w, p = hypothesis.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.007, abs=0.003)


def test_normality_votes(spark):
    from statistics import NormalDist

    good = spark.createDataFrame([(NormalDist(5, 2).inv_cdf((i + 0.5) / 300),) for i in range(300)], "v double")
    bad = spark.createDataFrame([(float(math.exp(i / 40)),) for i in range(300)], "v double")
    assert hypothesis.normality(good, "v")["likely_normal"] and not hypothesis.normality(bad, "v")["likely_normal"]


def test_time_series(spark):
    days = pd.date_range("2024-01-01", periods=120)
    v = np.arange(120) * 0.5 + 5 * np.sin(np.arange(120) * 2 * np.pi / 7)
    pdf = pd.DataFrame({"d": days, "v": v})
    df = spark.createDataFrame(pdf)
    got = timeseries.rolling(df, "d", "v", 4).orderBy("d").toPandas()
    want = pdf.v.rolling(4, center=True)
    assert np.allclose(got.rolling_mean, want.mean(), equal_nan=True) and np.allclose(got.rolling_std, want.std(), equal_nan=True)
    assert timeseries.frequency(df, "d") == "D"
    assert timeseries.missing_timestamps(df.where("d != date'2024-01-10'"), "d").count() == 1
    assert timeseries.mann_kendall(df, "d", "v")["trend"] == "increasing"
    assert timeseries.trend_test(df, "d", "v")["slope"] == pytest.approx(0.5, abs=0.02)
    assert timeseries.detect_period(v) == 7 or timeseries.detect_period(v) in (7, 8)
    parts = timeseries.component_strength(timeseries.decompose(df, "d", "v", 7)).first()
    assert parts.seasonal_strength > 0 and parts.trend_strength > 0.9
    acf = timeseries.acf_pacf(df, "d", "v", 10)
    assert acf["acf"][0] == pytest.approx(1.0) and 1 in acf["significant_acf"]
    season, trend, rest = timeseries.stl(v, 7)
    assert np.abs(rest[14:-14]).max() < 1.0 and np.allclose(season + trend + rest, v)
    assert timeseries.kpss(v)["stationary"] is False
    rng = np.random.default_rng(0)
    assert timeseries.adf(rng.normal(size=200))["stationary"] and not timeseries.adf(np.cumsum(rng.normal(size=200)))["stationary"]
    ar = np.zeros(400)
    for i in range(1, 400):
        ar[i] = 0.7 * ar[i - 1] + rng.normal()
    assert timeseries.arima_css(ar, 1, 0, 0)["theta"][1] == pytest.approx(0.7, abs=0.1)


def test_features(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i), "s" if i % 10 else "r") for i in range(1000)], "id int, a double, b double, g string")
    sample = features.stratified_sample(df, 100, "g", ["id"])
    assert {r.g: r["count"] for r in sample.groupBy("g").count().collect()} == {"s": 90, "r": 10}
    assert features.random_sample(df, 77, ["id"]).count() == 77
    assert [r.id for r in features.systematic_sample(df, 10, ["id"]).orderBy("id").collect()] == list(range(0, 1000, 100))
    assert features.systematic_sample(df, 7, ["id"]).count() == 7
    edges = [0.0, 3.0, 6.0, 9.0]
    got = df.select("a", features.bin_column(F.col("a"), edges, ["x", "y", "z"]).alias("b")).distinct().toPandas()
    want = pd.cut(got.a, edges, labels=["x", "y", "z"], include_lowest=True).astype(str)
    assert (got.b == want).all()
    quadratic = spark.createDataFrame([(float(x), float(x * x)) for x in range(-20, 21)], "x double, y double")
    found = features.detect_polynomials(quadratic, "y")
    assert found[0].feature == "x" and found[0].degree == 2
    result = features.analyze(df)
    code = features.generate_code(result)
    compile(code, "generated", "exec")
    assert features.encoded(df, "g", "label").select("g_label").distinct().count() == 2
    assert features.auto_target(5_000_000) == 22_360 or features.auto_target(5_000_000) == int(10 * math.sqrt(5_000_000))
    _, facts = features.smart_sample(df, ["id"], 50)
    assert facts["method"] == "stratified"


def test_patterns(spark, mixed):
    df, _ = mixed
    even = spark.createDataFrame([(float(i) + 1,) for i in range(200)], "v double")
    assert descriptive.patterns(even, "v")["uniform_like"] and not descriptive.patterns(even, "v")["exponential_like"]
    two = spark.createDataFrame([(float(i % 7),) for i in range(200)] + [(float(100 + i % 7),) for i in range(200)], "v double")
    assert descriptive.patterns(two, "v", 10)["multimodal"]
    assert hypothesis.anova_assumptions(df.where("x is not null"), "x", "g")["equal_variances"] in (True, False)


def test_charts(spark, mixed):
    df, pdf = mixed
    h = charts.histogram(df, "x", 10).orderBy("bin").collect()
    counts, edges = np.histogram(pdf.x, 10)
    assert {r.bin: r.n for r in h} == {i: n for i, n in enumerate(counts) if n}
    d = charts.density(df, "x", 50).orderBy("x").toPandas()
    assert np.trapezoid(d.density, d.x) == pytest.approx(1.0, abs=0.05)
    assert charts.qq(df, "x", 20)[0][0] < 0 < charts.qq(df, "x", 20)[-1][0]
    assert charts.svg_bars([("<a>", 1.0)], "t").startswith("<svg") and "&lt;a&gt;" in charts.svg_bars([("<a>", 1.0)], "t")
