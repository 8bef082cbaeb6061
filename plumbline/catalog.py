"""The registered queries over the reference's own operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import anomaly, charts, correlation, descriptive, features, hypothesis, outliers, quality, timeseries, validators

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, negative zero removed, so that two engines' sums agree."""
    return df.select(*[(F.round(F.col(c), own.get(c, digits)) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def rows(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], schema)


def union(template: str, names: list[str]) -> str:
    return " UNION ALL ".join(template.replace("{c}", n) for n in names)


def queries() -> dict[str, Query]:
    from . import catalog_more  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_more  # noqa: F401

    return dict(SQL)


# Descriptive -------------------------------------------------------------------------------------


@query(
    union(
        "SELECT '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, (SELECT min({c}) FROM (SELECT {c}, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}) "
        "WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}))) AS mode, round(stddev_samp({c}), 6) AS std, round(var_samp({c}), 4) AS variance, min({c}) AS min, max({c}) AS max, "
        "round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis, round(quantile_cont({c}, 0.05), 6) AS p05, round(quantile_cont({c}, 0.10), 6) AS p10, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, "
        "round(quantile_cont({c}, 0.75), 6) AS q3, round(quantile_cont({c}, 0.90), 6) AS p90, round(quantile_cont({c}, 0.95), 6) AS p95, round(max({c}) - min({c}), 6) AS range, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr, "
        "round(100 * stddev_samp({c}) / avg({c}), 6) AS cv FROM lineitem",
        MEASURES,
    )
)
def profile_numeric(spark, sf_dir):
    return tidy(descriptive.describe_numeric(table(spark, sf_dir, "lineitem"), MEASURES), variance=4)


@query(union("SELECT '{c}' AS column_name, round(median({c}), 6) AS median, round(mad({c}), 6) AS mad FROM lineitem", MEASURES))
def median_deviation(spark, sf_dir):
    return tidy(descriptive.median_deviation(table(spark, sf_dir, "lineitem"), MEASURES))


@query(union("SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, min({c}) AS min, max({c}) AS max, count(*) - count({c}) AS missing FROM lineitem", MEASURES))
def streaming_statistics(spark, sf_dir):
    return tidy(descriptive.streaming_statistics(table(spark, sf_dir, "lineitem"), MEASURES))


SHAPE = "CASE WHEN abs(s) < 0.5 THEN 'symmetric' WHEN abs(s) < 1 THEN 'moderately skewed' WHEN s > 0 THEN 'highly right-skewed' ELSE 'highly left-skewed' END AS skewness_type, CASE WHEN k < -1 THEN 'platykurtic' WHEN k > 1 THEN 'leptokurtic' ELSE 'mesokurtic' END AS kurtosis_type, CASE WHEN abs(s) < 0.5 AND abs(k) < 0.5 THEN 'normal' WHEN abs(s) < 0.5 THEN 'symmetric_non_normal' WHEN s > 0 THEN 'right_skewed' ELSE 'left_skewed' END AS distribution"


@query(f"SELECT column_name, n_unique, round(s, 6) AS skewness, round(k, 6) AS kurtosis, n_unique < 20 AS is_discrete, {SHAPE} FROM (" + union("SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, skewness({c}) AS s, kurtosis({c}) AS k FROM lineitem", MEASURES) + ")")
def distribution_shapes(spark, sf_dir):
    return tidy(descriptive.distributions(table(spark, sf_dir, "lineitem"), MEASURES))


ORDER_TEXTS = ["o_orderstatus", "o_orderpriority"]


@query(
    "WITH c AS (" + union("SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM orders GROUP BY {c}", ORDER_TEXTS) + "), t AS (SELECT column_name, CAST(sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS count, CAST(sum(CASE WHEN value IS NULL THEN n ELSE 0 END) AS BIGINT) AS missing, "
    "count(value) AS n_unique, max(CASE WHEN value IS NOT NULL THEN n END) AS mode_count, sum(CASE WHEN value IS NOT NULL THEN n * log2(n) END) AS nl FROM c GROUP BY column_name) "
    "SELECT t.column_name, t.count, missing, n_unique, (SELECT min(value) FROM c WHERE c.column_name = t.column_name AND c.n = t.mode_count) AS mode, mode_count, round(100.0 * mode_count / t.count, 6) AS mode_percentage, round(log2(t.count) - nl / t.count, 6) AS entropy, "
    "round(log2(n_unique), 6) AS max_entropy, round((log2(t.count) - nl / t.count) / log2(n_unique), 6) AS diversity FROM t"
)
def categorical_profile(spark, sf_dir):
    return tidy(descriptive.categorical_profile(table(spark, sf_dir, "orders"), ORDER_TEXTS))


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM (" + union("SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY {c}", ["p_brand", "p_type"]) + ")) WHERE rank <= 10")
def value_counts_top10(spark, sf_dir):
    return descriptive.value_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("SELECT count(*) AS rows, 6::BIGINT AS columns, 3::BIGINT AS numeric_columns, 2::BIGINT AS categorical_columns, 1::BIGINT AS datetime_columns, 0::BIGINT AS other_columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicate_rows FROM orders")
def overview(spark, sf_dir):
    return descriptive.overview(table(spark, sf_dir, "orders"))


@query("SELECT l_returnflag AS group_value, count(*) AS n, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, max(l_extendedprice) AS max, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY 1")
def grouped_distribution(spark, sf_dir):
    return tidy(descriptive.grouped_distribution(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag"))


@query(
    "SELECT event_type AS series, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, round(median(value), 6) AS median, "
    "round(sum(pow(value - m, 3)) / count(value) / pow(stddev_pop(value), 3), 6) AS skewness, round(sum(pow(value - m, 4)) / count(value) / pow(stddev_pop(value), 4) - 3, 6) AS kurtosis, round(stddev_samp(value) / avg(value), 6) AS cv "
    "FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events WHERE value IS NOT NULL) GROUP BY event_type"
)
def compare_series(spark, sf_dir):
    return tidy(descriptive.compare_series(table(spark, sf_dir, "events"), "event_type", "value"))


@query(
    "WITH r AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, CASE WHEN grouping(l_returnflag) = 1 THEN 0 WHEN grouping(l_linestatus) = 1 THEN 1 ELSE 2 END AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)) "
    "SELECT c.l_returnflag, c.l_linestatus, CAST(c.level AS BIGINT) AS level, round(c.total, 4) AS total, round(coalesce(100.0 * c.total / p.total, 100.0), 6) AS percent_of_parent FROM r c LEFT JOIN r p ON p.level = c.level - 1 AND (p.level = 0 OR p.l_returnflag = c.l_returnflag)"
)
def rollup_hierarchy(spark, sf_dir):
    return tidy(descriptive.hierarchy_totals(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"), total=4)


@query("WITH u AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings) SELECT 'x' AS column_name, count(x) AS count, round(avg(x::DOUBLE), 6) AS mean, round(stddev_pop(x::DOUBLE), 6) AS std, round(min(x::DOUBLE), 6) AS min, round(max(x::DOUBLE), 6) AS max, 0::BIGINT AS missing FROM u")
def vector_components(spark, sf_dir):
    flat = table(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("x")).select(F.col("x").cast("double").alias("x"))
    return tidy(descriptive.streaming_statistics(flat, ["x"]))


@query(
    "WITH v AS (SELECT o_totalprice AS v, cume_dist() OVER (ORDER BY o_totalprice) AS c, count(*) OVER (PARTITION BY o_totalprice) AS t, count(*) OVER () AS n, min(o_totalprice) OVER () AS lo, max(o_totalprice) OVER () AS hi, avg(o_totalprice) OVER () AS m FROM orders), "
    "f AS (SELECT *, (v - lo) / (hi - lo) AS u, 1 - exp(-(v - lo) / (m - lo)) AS e FROM v) SELECT max(n) AS n, round(max(greatest(c - u, u - (c - t / n::DOUBLE))), 6) AS d_uniform, round(max(greatest(c - e, e - (c - t / n::DOUBLE))), 6) AS d_exponential FROM f"
)
def pattern_distances(spark, sf_dir):
    return tidy(descriptive.pattern_distances(table(spark, sf_dir, "orders"), "o_totalprice"))


@query("SELECT 'l_quantity' AS column_name, a.n AS count_left, round(a.m, 6) AS mean_left, round(a.s, 6) AS std_left, b.n AS count_right, round(b.m, 6) AS mean_right, round(b.s, 6) AS std_right, round(b.m - a.m, 6) AS mean_change FROM (SELECT count(*) AS n, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_returnflag = 'A') a, (SELECT count(*) AS n, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_returnflag = 'N') b")
def compare_tables(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    pick = lambda flag: lines.where(F.col("l_returnflag") == flag).select("l_quantity")
    return tidy(descriptive.compare_tables(pick("A"), pick("N")))


@query("SELECT 'n_nationkey' AS column_name, CAST(4 * count(*) AS BIGINT) AS bytes FROM nation UNION ALL SELECT 'n_name', CAST(sum(strlen(n_name)) AS BIGINT) FROM nation UNION ALL SELECT 'n_regionkey', CAST(4 * count(*) AS BIGINT) FROM nation")
def estimated_bytes(spark, sf_dir):
    return descriptive.estimated_bytes(table(spark, sf_dir, "nation"))


# Quality -----------------------------------------------------------------------------------------

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(union("SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_rate, count(*) > count({c}) AS has_missing, 100.0 * (count(*) - count({c})) / count(*) > 10 AS above_threshold FROM customer", CUSTOMER))
def missing_profile(spark, sf_dir):
    return tidy(quality.missing(table(spark, sf_dir, "customer")))


@query(
    "WITH p AS (SELECT (event_id IS NOT NULL)::INT + (ts IS NOT NULL)::INT + (user_id IS NOT NULL)::INT + (event_type IS NOT NULL)::INT + (value IS NOT NULL)::INT + (props IS NOT NULL)::INT AS p FROM events) "
    "SELECT count(*) FILTER (WHERE p = 0) AS rows_all_missing, count(*) FILTER (WHERE p < 6) AS rows_any_missing, round(avg(100.0 * p / 6), 6) AS mean_completeness, round(min(100.0 * p / 6), 6) AS min_completeness, round(max(100.0 * p / 6), 6) AS max_completeness, round(stddev_samp(100.0 * p / 6), 6) AS std_completeness FROM p"
)
def row_completeness(spark, sf_dir):
    return tidy(quality.row_completeness(table(spark, sf_dir, "events")))


@query(
    "WITH g AS (SELECT l_quantity, l_discount, l_tax, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS duplicate_groups, count(*) AS unique_rows, round(100.0 * sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS duplicate_rate FROM g"
)
def duplicates_summary(spark, sf_dir):
    return tidy(quality.duplicates(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag"]))


@query("SELECT l_quantity, l_discount, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return quality.duplicate_groups(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])


@query(union("SELECT '{c}' AS column_name, count(*) - count(DISTINCT {c}) - max(({c} IS NULL)::INT) AS duplicates, count(DISTINCT {c}) AS n_unique FROM customer", CUSTOMER))
def column_duplicates(spark, sf_dir):
    return quality.column_duplicates(table(spark, sf_dir, "customer"))


@query(
    "SELECT column_name, n_unique, round(100.0 * n_unique / n, 6) AS unique_rate, n_unique = n AS is_unique, CASE WHEN n_unique = 1 THEN 'constant' WHEN n_unique = n THEN 'unique' WHEN n_unique <= 10 THEN 'low' WHEN n_unique > 50 THEN 'high' ELSE 'medium' END AS level FROM ("
    + union("SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, count(*) AS n FROM customer", CUSTOMER) + ")"
)
def cardinality_levels(spark, sf_dir):
    return tidy(quality.cardinality(table(spark, sf_dir, "customer")))


@query(
    "WITH s AS (" + union("SELECT '{c}' AS column_name, false AS t, count(*) AS n, count(DISTINCT {c}) AS u, 0 AS bad FROM customer", ["c_custkey", "c_nationkey", "c_acctbal"]) + " UNION ALL "
    + union("SELECT '{c}' AS column_name, true AS t, count(*) AS n, count(DISTINCT {c}) AS u, count(*) FILTER (WHERE NOT regexp_full_match({c}, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*')) AS bad FROM customer", ["c_name", "c_mktsegment"])
    + ") SELECT column_name, 'category' AS suggestion FROM s WHERE (NOT t AND u < 10 AND n > 20) OR (t AND u < 0.5 * n AND u < 100) UNION ALL SELECT column_name, 'numeric' FROM s WHERE t AND bad = 0"
)
def type_suggestions(spark, sf_dir):
    return quality.type_suggestions(table(spark, sf_dir, "customer"))


@query(union("SELECT '{c}' AS column_name, count(*) FILTER (WHERE isinf({c}::DOUBLE)) AS infinite, count(*) FILTER (WHERE {c} < 0) AS negative, count(*) FILTER (WHERE {c} = 0) AS zero, false AS unexpected_negative FROM customer", ["c_custkey", "c_nationkey", "c_acctbal"]))
def numeric_checks(spark, sf_dir):
    return quality.numeric_checks(table(spark, sf_dir, "customer"))


@query(
    union(
        "SELECT '{c}' AS column_name, count(*) FILTER (WHERE regexp_matches({c}, '^\\s|\\s$')) AS space_around, count(*) FILTER (WHERE {c} = '') AS empty, count(DISTINCT {c}) AS n_unique, count(DISTINCT lower({c})) AS n_unique_lower, min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 6) AS avg_length, count(DISTINCT {c}) <> count(DISTINCT lower({c})) AS case_inconsistent FROM part",
        ["p_name", "p_brand", "p_type"],
    )
)
def text_checks(spark, sf_dir):
    return tidy(quality.text_checks(table(spark, sf_dir, "part")))


@query(
    "WITH s AS (SELECT 100.0 AS completeness, 100.0 * (SELECT count(*) FROM (SELECT DISTINCT * FROM nation)) / count(*) AS uniqueness, 100.0 AS consistency, 100 * (1 - 1 / 3.0) AS validity FROM nation) "
    "SELECT round(completeness, 6) AS completeness, round(uniqueness, 6) AS uniqueness, round(consistency, 6) AS consistency, round(validity, 6) AS validity, round(0.35 * completeness + 0.25 * uniqueness + 0.2 * consistency + 0.2 * validity, 6) AS overall_score, CASE WHEN 0.35 * completeness + 0.25 * uniqueness + 0.2 * consistency + 0.2 * validity >= 90 THEN 'excellent' ELSE 'good' END AS level FROM s"
)
def quality_score(spark, sf_dir):
    return tidy(quality.quality_score(table(spark, sf_dir, "nation")))


RULES = [
    ("o_totalprice", "range", {"min_value": 1000, "max_value": 200000}), ("o_orderstatus", "allowed", {"values": ["F", "O"]}), ("o_orderpriority", "pattern", {"pattern": "[1-3]-"}),
    ("o_orderpriority", "length", {"min_length": 6, "max_length": 10}), ("o_orderkey", "unique", {}), ("o_custkey", "not_null", {}),
]


@query(
    "SELECT 'o_totalprice' AS column_name, 'range' AS rule, count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 200000) AS violations FROM orders UNION ALL SELECT 'o_orderstatus', 'allowed', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders "
    "UNION ALL SELECT 'o_orderpriority', 'pattern', count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')) FROM orders UNION ALL SELECT 'o_orderpriority', 'length', count(*) FILTER (WHERE length(o_orderpriority) < 6 OR length(o_orderpriority) > 10) FROM orders "
    "UNION ALL SELECT 'o_orderkey', 'unique', count(*) - count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'o_custkey', 'not_null', count(*) - count(o_custkey) FROM orders"
)
def validation_rules(spark, sf_dir):
    return validators.check_rules(table(spark, sf_dir, "orders"), RULES)


# Correlation -------------------------------------------------------------------------------------

PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM lineitem" for a, b in PAIRS))
def pearson_matrix(spark, sf_dir):
    return tidy(correlation.pearson(table(spark, sf_dir, "lineitem"), MEASURES))


def _rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(" UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(corr(x, y), 6) AS r, count(*) AS n FROM (SELECT {_rank(a)} AS x, {_rank(b)} AS y FROM lineitem)" for a, b in PAIRS[:3] + PAIRS[3:]))
def spearman_matrix(spark, sf_dir):
    return tidy(correlation.spearman(table(spark, sf_dir, "lineitem"), MEASURES))


@query("WITH p AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part), s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM p a, p b), t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM p GROUP BY x)) AS tx, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM p GROUP BY y)) AS ty, (SELECT count(*) FROM p) AS n) SELECT 'p_size' AS feature1, 'p_retailprice' AS feature2, round(s.s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) AS r, n FROM s, t")
def kendall_tau(spark, sf_dir):
    return tidy(correlation.kendall(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]))


@query("SELECT feature1, feature2, round(r, 6) AS r, n, CASE WHEN abs(r) >= 0.9 THEN 'very_strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'very_weak' END AS strength, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS r, count(*) AS n FROM lineitem" for a, b in PAIRS) + ") WHERE abs(r) >= 0.001")
def strong_pairs(spark, sf_dir):
    return tidy(correlation.strong_pairs(table(spark, sf_dir, "lineitem"), 0.001, MEASURES))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 6) AS vif, false AS high FROM lineitem" for c in ("l_extendedprice", "l_quantity")))
def variance_inflation(spark, sf_dir):
    found = correlation.vif(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return tidy(rows(spark, found, "feature string, vif double, high boolean"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem")
def scatter_regression(spark, sf_dir):
    return tidy(correlation.regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), slope=4, intercept=4)


@query(
    "WITH h AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS r FROM lineitem" for a, b in PAIRS) + ") SELECT feature1, feature2, round(r, 6) AS r, true AS masked FROM h UNION ALL SELECT feature2, feature1, round(r, 6), false FROM h UNION ALL SELECT f, f, 1.0, true FROM (SELECT feature1 AS f FROM h UNION SELECT feature2 FROM h)"
)
def correlation_heatmap(spark, sf_dir):
    return tidy(charts.correlation_heatmap(table(spark, sf_dir, "lineitem"), MEASURES, mask_upper=True, mask_diagonal=True))


# Outliers ----------------------------------------------------------------------------------------


def _outlier_sql(bounds: str) -> str:
    one = "SELECT '{c}' AS column_name, round(lo, 4) AS lower, round(hi, 4) AS upper, count(*) FILTER (WHERE {c} < lo) AS below, count(*) FILTER (WHERE {c} > hi) AS above, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers, round(100.0 * count(*) FILTER (WHERE {c} < lo OR {c} > hi) / count({c}), 6) AS percentage FROM lineitem, (" + bounds + ") GROUP BY lo, hi"
    return union(one, MEASURES)


IQR = _outlier_sql("SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM lineitem")
ZSCORE = _outlier_sql("SELECT avg({c}) - 3.0 * stddev_pop({c}) AS lo, avg({c}) + 3.0 * stddev_pop({c}) AS hi FROM lineitem")
MODIFIED = _outlier_sql("SELECT median({c}) - 3.5 * mad({c}) / 0.6745 AS lo, median({c}) + 3.5 * mad({c}) / 0.6745 AS hi FROM lineitem")


@query(IQR)
def iqr_outliers(spark, sf_dir):
    return tidy(outliers.outliers(table(spark, sf_dir, "lineitem"), "iqr", columns=MEASURES), lower=4, upper=4)


@query(ZSCORE)
def zscore_outliers(spark, sf_dir):
    return tidy(outliers.outliers(table(spark, sf_dir, "lineitem"), "zscore", columns=MEASURES), lower=4, upper=4)


@query(MODIFIED)
def modified_zscore_outliers(spark, sf_dir):
    return tidy(outliers.outliers(table(spark, sf_dir, "lineitem"), "modified_zscore", columns=MEASURES), lower=4, upper=4)


@query(" UNION ALL ".join(f"SELECT '{m}' AS method, CAST(sum(outliers) AS BIGINT) AS total_outliers, count(*) FILTER (WHERE outliers > 0) AS columns_with_outliers FROM ({s})" for m, s in (("iqr", IQR), ("zscore", ZSCORE), ("modified_zscore", MODIFIED))))
def outlier_summary(spark, sf_dir):
    return outliers.summary(table(spark, sf_dir, "lineitem"), columns=MEASURES)


BOUNDS = "SELECT quantile_cont(o_totalprice, 0.25) - (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) * 0.2 AS lo, quantile_cont(o_totalprice, 0.75) + (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) * 0.2 AS hi FROM orders"


@query(f"SELECT o_orderkey, o_totalprice < lo OR o_totalprice > hi AS is_anomaly, round(greatest(lo - o_totalprice, o_totalprice - hi, 0.0), 4) AS anomaly_score FROM orders, ({BOUNDS})")
def iqr_scores(spark, sf_dir):
    return tidy(outliers.score_rows(table(spark, sf_dir, "orders"), "o_totalprice", "iqr", 0.2).select("o_orderkey", "is_anomaly", "anomaly_score"), anomaly_score=4)


@query("SELECT event_id, coalesce(abs(value - m) / s > 2, false) AS is_anomaly, round(coalesce(abs(value - m) / s, 0.0), 6) AS anomaly_score FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)")
def zscore_scores(spark, sf_dir):
    return tidy(outliers.score_rows(table(spark, sf_dir, "events"), "value", "zscore", 2.0).select("event_id", "is_anomaly", "anomaly_score"))


@query(
    "WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_tax) AS mt, stddev_samp(l_tax) AS st FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, abs(l_quantity - mq) / sq AS q, abs(l_tax - mt) / st AS t FROM lineitem, s WHERE l_quantity >= 49) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN q >= t THEN 'l_quantity' ELSE 'l_tax' END AS feature, round(greatest(q, t), 6) AS contribution FROM r"
)
def top_contributions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_quantity", "l_tax", (F.col("l_quantity") >= 49).alias("flag"))
    found = outliers.feature_contributions(lines, "flag", ["l_quantity", "l_tax"], top=1).select(*LINE_KEY, F.col("contributions")[0]["feature"].alias("feature"), F.col("contributions")[0]["contribution"].alias("contribution"))
    return tidy(found)


@query(
    "WITH m AS (SELECT avg(c_acctbal) AS ma, avg(c_nationkey) AS mn, var_samp(c_acctbal) AS va, var_samp(c_nationkey) AS vn, covar_samp(c_acctbal, c_nationkey) AS c FROM customer), d AS (SELECT c_custkey, sqrt((vn * pow(c_acctbal - ma, 2) - 2 * c * (c_acctbal - ma) * (c_nationkey - mn) + va * pow(c_nationkey - mn, 2)) / (va * vn - c * c)) AS d FROM customer, m) "
    "SELECT c_custkey, round(d, 6) AS anomaly_score FROM d"
)
def mahalanobis_distances(spark, sf_dir):
    return tidy(anomaly.mahalanobis(table(spark, sf_dir, "customer"), ["c_custkey"], ["c_acctbal", "c_nationkey"]).select("c_custkey", "anomaly_score"))


@query()
def isolation_forest(spark, sf_dir):
    return anomaly.isolation_forest(table(spark, sf_dir, "customer"), ["c_custkey"], ["c_acctbal", "c_nationkey"])


@query()
def local_outlier_factor(spark, sf_dir):
    return tidy(anomaly.local_outlier_factor(table(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_acctbal", "s_nationkey"]), 4)


@query()
def elliptic_envelope(spark, sf_dir):
    return anomaly.elliptic_envelope(table(spark, sf_dir, "customer"), ["c_custkey"], ["c_acctbal", "c_nationkey"])


@query()
def dbscan_noise(spark, sf_dir):
    return tidy(anomaly.dbscan(table(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_acctbal", "s_nationkey"]), 5)


@query()
def ensemble_anomalies(spark, sf_dir):
    return anomaly.ensemble(table(spark, sf_dir, "supplier"), ["s_suppkey"], columns=["s_acctbal", "s_nationkey"])


# Hypothesis tests --------------------------------------------------------------------------------


@query("SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS observed, round(max(ra) * max(cb) / max(n)::DOUBLE, 6) AS expected FROM (SELECT *, count(*) OVER (PARTITION BY o_orderstatus) AS ra, count(*) OVER (PARTITION BY o_orderpriority) AS cb, count(*) OVER () AS n FROM orders) GROUP BY 1, 2")
def contingency_table(spark, sf_dir):
    return tidy(hypothesis.contingency(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


@query(
    "WITH e AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o, max(ra) * max(cb) / max(n)::DOUBLE AS e, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY o_orderstatus) AS ra, count(*) OVER (PARTITION BY o_orderpriority) AS cb, count(*) OVER () AS n FROM orders) GROUP BY 1, 2) "
    "SELECT round(sum(pow(o - e, 2) / e), 6) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, max(n) AS n, round(sqrt(sum(pow(o - e, 2) / e) / (max(n) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6) AS cramers_v, round(min(e), 6) AS min_expected FROM e"
)
def chi_square_statistic(spark, sf_dir):
    return tidy(hypothesis.chi_square_table(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


ANOVA = "WITH g AS (SELECT {g} AS g, count({v}) AS n, avg({v}) AS m, var_samp({v}) AS v FROM {t} GROUP BY 1), s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * pow(m - (SELECT avg({v}) FROM {t}), 2)) AS b, sum((n - 1) * v) AS w FROM g) SELECT k AS groups, n, {r}(b, 0) AS ss_between, {r}(w, 0) AS ss_within, round((b / (k - 1)) / (w / (n - k)), 5) AS f, round(b / (b + w), 6) AS eta_squared FROM s"


@query(ANOVA.format(g="o_orderpriority", v="o_totalprice", t="orders", r="round").replace("round(b, 0)", "round(b / 1e6, 2)").replace("round(w, 0)", "round(w / 1e6, 0)"))
def anova(spark, sf_dir):
    found = hypothesis.anova_table(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")
    return tidy(found.withColumns({"ss_between": F.col("ss_between") / 1e6, "ss_within": F.col("ss_within") / 1e6}), ss_between=2, ss_within=0, f=5)


@query("WITH d AS (SELECT l_returnflag AS g, abs(l_quantity - median(l_quantity) OVER (PARTITION BY l_returnflag)) AS d FROM lineitem) " + ANOVA.format(g="g", v="d", t="d", r="round").replace("WITH g AS", ", g AS").replace("round(b, 0)", "round(b, 4)").replace("round(w, 0)", "round(w, 2)"))
def levene_statistic(spark, sf_dir):
    return tidy(hypothesis.levene_table(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag"), ss_between=4, ss_within=2, f=5)


@query("WITH g AS (SELECT l_returnflag AS g, count(*) - 1 AS f, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), s AS (SELECT count(*) AS k, sum(f) AS f, sum(f * v) AS fv, sum(f * ln(v)) AS flv, sum(1.0 / f) AS i FROM g) SELECT round((f * ln(fv / f) - flv) / (1 + (i - 1.0 / f) / (3 * (k - 1))), 5) AS t, k AS groups FROM s")
def bartlett_statistic(spark, sf_dir):
    return tidy(hypothesis.bartlett_table(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag"), t=5)


RANKED = "WITH r AS (SELECT {g} AS g, {v} AS v, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS r FROM {t}), tie AS (SELECT sum(pow(n::DOUBLE, 3) - n) AS t FROM (SELECT count(*) AS n FROM r GROUP BY v)), s AS (SELECT g, count(*) AS n, sum(r) AS s FROM r GROUP BY g) "


@query(RANKED.format(g="l_returnflag", v="l_quantity", t="lineitem") + ", h AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, (12.0 / (sum(n)::DOUBLE * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - max(t) / (pow(sum(n)::DOUBLE, 3) - sum(n))) AS h FROM s, tie) SELECT round(h, 4) AS h, k AS groups, n, round((h - k + 1) / (n - k), 6) AS epsilon_squared FROM h")
def kruskal_statistic(spark, sf_dir):
    return tidy(hypothesis.kruskal_table(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag"), h=4)


@query(RANKED.format(g="o_orderstatus", v="o_totalprice", t="(SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O'))") + "SELECT g, n, round(s, 1) AS rank_sum, round(t, 1) AS ties FROM s, tie")
def rank_sums(spark, sf_dir):
    return tidy(hypothesis.rank_sums(table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')"), "o_totalprice", "o_orderstatus"), rank_sum=1, ties=1)


@query("WITH d AS (SELECT l_quantity - 25.0 AS d FROM lineitem WHERE l_quantity <> 25), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d) SELECT round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 1) AS w_plus, round(sum(CASE WHEN d < 0 THEN r ELSE 0 END), 1) AS w_minus, count(*) AS n, round((SELECT sum(pow(n::DOUBLE, 3) - n) FROM (SELECT count(*) AS n FROM d GROUP BY abs(d))), 1) AS ties FROM r")
def signed_ranks(spark, sf_dir):
    shifted = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25.0).alias("d"))
    return tidy(hypothesis.signed_rank_table(shifted, "d"), w_plus=1, w_minus=1, ties=1)


@query("WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS cohens_d, a.n AS n1, b.n AS n2 FROM g a, g b WHERE a.g = 'F' AND b.g = 'O'")
def cohens_d(spark, sf_dir):
    return tidy(hypothesis.cohens_d_table(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus", "F", "O"))


@query("WITH p AS (SELECT n_nationkey, (n_nationkey + 1) / 400.0 AS p FROM nation), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS k FROM p) SELECT n_nationkey, round(p, 6) AS p, round(least(1.0, p * m), 6) AS bonferroni, round(max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY p), 6) AS holm FROM r")
def corrected_p_values(spark, sf_dir):
    return tidy(hypothesis.corrected(table(spark, sf_dir, "nation").select("n_nationkey", ((F.col("n_nationkey") + 1) / 400.0).alias("p")), "p"))


@query()
def normality_tests(spark, sf_dir):
    r = hypothesis.normality(table(spark, sf_dir, "customer"), "c_acctbal")
    flat = [{"test": k, "statistic": list(v.values())[0], "second": list(v.values())[1]} for k, v in r.items() if isinstance(v, dict)]
    return tidy(rows(spark, flat, "test string, statistic double, second double"))


@query()
def tukey_comparisons(spark, sf_dir):
    found = hypothesis.tukey_hsd(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")
    return tidy(rows(spark, found, "group1 string, group2 string, mean_difference double, lower double, upper double, p_adjusted double, reject boolean"), 4)


@query()
def two_way_anova(spark, sf_dir):
    found = hypothesis.two_way_anova(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus")
    return tidy(rows(spark, [{k: float(v) if k in ("ss", "f", "p_value") and v is not None else v for k, v in r.items()} for r in found], "term string, ss double, df long, f double, p_value double"), 4)


@query()
def granger_causality(spark, sf_dir):
    daily = timeseries.resample(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "D", "mean").select("period", "value", F.col("n").cast("double").alias("orders"))
    found = hypothesis.granger(daily, "period", "value", "orders", 3)
    return tidy(rows(spark, [{k: float(v) if k != "lag" else v for k, v in r.items()} for r in found["lags"]], "lag long, f double, p_value double, chi2 double, lr double"), 5)


# Time series -------------------------------------------------------------------------------------

DAILY = "SELECT date_trunc('day', o_orderdate) AS period, avg(o_totalprice) AS value, count(o_totalprice) AS n FROM orders GROUP BY 1"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.resample(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "D", "mean")


def day(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.date_format(c, "yyyy-MM-dd"))


@query(f"SELECT strftime(period, '%Y-%m-%d') AS period, round(value, 7) AS value, n FROM ({DAILY})")
def resample_daily(spark, sf_dir):
    return tidy(day(daily(spark, sf_dir), "period"), 7)


@query("SELECT strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS period, round(sum(o_totalprice), 2) AS value, count(o_totalprice) AS n FROM orders GROUP BY 1")
def resample_weekly(spark, sf_dir):
    return tidy(day(timeseries.resample(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "W", "sum"), "period"), 2)


@query(f"SELECT strftime(period, '%Y-%m-%d') AS period, round(value, 7) AS value, n, CASE WHEN count(value) OVER w = 7 THEN round(avg(value) OVER w, 4) END AS rolling_mean, CASE WHEN count(value) OVER w = 7 THEN round(stddev_samp(value) OVER w, 4) END AS rolling_std FROM ({DAILY}) WINDOW w AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def rolling_statistics(spark, sf_dir):
    return tidy(day(timeseries.rolling(daily(spark, sf_dir), "period", "value", 7), "period"), 4, value=7)


@query(" UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS lag, round(corr(x, value), 6) AS r, count(x) AS n FROM (SELECT value, lag(value, {k}) OVER (ORDER BY period) AS x FROM ({DAILY}))" for k in (1, 2, 7)))
def lag_correlations(spark, sf_dir):
    return tidy(timeseries.lag_correlation(daily(spark, sf_dir), "period", "value", [1, 2, 7]))


@query("SELECT CAST(week(p) AS BIGINT) AS row, CAST(year(p) AS BIGINT) AS year, round(avg(value), 7) AS value FROM (SELECT period AS p, value FROM (" + DAILY + ")) GROUP BY 1, 2")
def week_year_heatmap(spark, sf_dir):
    return tidy(timeseries.heatmap(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "D"), 7)


@query("WITH d AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS t FROM orders), g AS (SELECT unnest(generate_series(min(t)::TIMESTAMP, max(t)::TIMESTAMP, INTERVAL 1 DAY)) AS t FROM d) SELECT strftime(t, '%Y-%m-%d') AS t FROM g WHERE t NOT IN (SELECT t FROM d)")
def missing_days(spark, sf_dir):
    return day(timeseries.missing_timestamps(table(spark, sf_dir, "orders"), "o_orderdate", "D"), "t")


PLACED = f"SELECT row_number() OVER (ORDER BY period) - 1 AS i, value AS v FROM ({DAILY})"


@query(f"SELECT round(regr_slope(v, i), 5) AS slope, round(regr_intercept(v, i), 3) AS intercept, round(regr_r2(v, i), 6) AS r2, count(*) AS n, round(sqrt((1 - regr_r2(v, i)) * regr_syy(v, i) / ((count(*) - 2) * regr_sxx(v, i))), 5) AS stderr FROM ({PLACED})")
def linear_trend(spark, sf_dir):
    return tidy(timeseries.linear_trend(daily(spark, sf_dir), "period", "value"), 5, intercept=3, r2=6)


@query(f"WITH p AS ({PLACED}) SELECT CAST(sum(sign(b.v - a.v)) AS BIGINT) AS s, (SELECT count(*) FROM p) AS n FROM p a JOIN p b ON a.i < b.i")
def mann_kendall_s(spark, sf_dir):
    return timeseries.mann_kendall_s(daily(spark, sf_dir), "period", "value")


@query(f"SELECT CAST(i % 7 AS BIGINT) AS phase, round(avg(v), 4) AS mean, count(*) AS n FROM ({PLACED}) GROUP BY 1")
def seasonal_means(spark, sf_dir):
    return tidy(timeseries.seasonal_means(daily(spark, sf_dir), "period", "value", 7), 4)


@query(
    f"WITH p AS ({PLACED}), t AS (SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(v) OVER w END AS trend FROM p WINDOW w AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), s AS (SELECT i % 7 AS phase, avg(v - trend) AS raw FROM t GROUP BY 1), c AS (SELECT phase, raw - avg(raw) OVER () AS seasonal FROM s) "
    "SELECT CAST(i AS BIGINT) AS i, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(v - trend - seasonal, 3) AS residual FROM t JOIN c ON t.i % 7 = c.phase"
)
def classical_decomposition(spark, sf_dir):
    parts = timeseries.decompose(daily(spark, sf_dir), "period", "value", 7)
    return tidy(parts.select((F.row_number().over(Window.orderBy("t")) - 1).cast("long").alias("i"), "trend", "seasonal", "residual"), 3)


@query("SELECT CAST(0 AS BIGINT) AS lag, 1.0 AS acf UNION ALL " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS lag, round(sum(d * e) / max(s), 6) AS acf FROM (SELECT d, lag(d, {k}) OVER (ORDER BY i) AS e, sum(d * d) OVER () AS s FROM (SELECT i, v - avg(v) OVER () AS d FROM ({PLACED})))" for k in range(1, 6)))
def autocorrelations(spark, sf_dir):
    return tidy(timeseries.autocorrelation(daily(spark, sf_dir), "period", "value", 5))


@query(
    f"WITH b AS (SELECT period, value AS x, n::DOUBLE AS y FROM ({DAILY})), d AS (SELECT period, x - avg(x) OVER () AS dx, y - avg(y) OVER () AS dy, (SELECT count(*) * stddev_pop(x) * stddev_pop(y) FROM b) AS s FROM b) "
    + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS lag, round(sum(e * dy) / max(s), 6) AS ccf FROM (SELECT lead(dx, {k}) OVER (ORDER BY period) AS e, dy, s FROM d)" for k in range(4))
)
def cross_correlations(spark, sf_dir):
    d = daily(spark, sf_dir)
    return tidy(timeseries.cross_correlation(d, d.select("period", F.col("n").cast("double").alias("count")), "period", "value", "count", 3))


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) "
    "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n_events FROM g GROUP BY user_id, s"
)
def session_activity(spark, sf_dir):
    found = timeseries.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"])
    return found.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n_events")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    t = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return tidy(t.groupBy(F.window("t", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"), 4)


@query()
def stl_anomalies(spark, sf_dir):
    return day(timeseries.stl_anomalies(daily(spark, sf_dir), "period", "value", 7), "t")


@query()
def arima_forecast(spark, sf_dir):
    monthly = timeseries.resample(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "M", "mean")
    fit = timeseries.auto_arima(monthly, "period", "value", 2, 1, 1)
    return tidy(rows(spark, timeseries.forecast(fit, 6), "step long, mean double, lower double, upper double"), 2)


# Features, sampling, charts -----------------------------------------------------------------------


@query("WITH s AS (SELECT l_returnflag, count(*) AS c FROM lineitem GROUP BY 1) SELECT l_returnflag, greatest(1, CAST(floor(1000 * c / (SELECT sum(c) FROM s)) AS BIGINT)) AS n FROM s")
def stratified_counts(spark, sf_dir):
    return features.stratified_sample(table(spark, sf_dir, "lineitem"), 1000, "l_returnflag", LINE_KEY).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), j AS (SELECT CAST(floor(g * (SELECT max(n) FROM p) / 500) AS BIGINT) AS i FROM (SELECT unnest(range(500)) AS g)) SELECT o_orderkey FROM p WHERE i IN (SELECT i FROM j)")
def systematic_sample(spark, sf_dir):
    return features.systematic_sample(table(spark, sf_dir, "orders").select("o_orderkey"), 500, ["o_orderkey"])


@query()
def random_sample(spark, sf_dir):
    return features.random_sample(table(spark, sf_dir, "orders"), 1000, ["o_orderkey"]).select("o_orderkey")


EDGES = [0.0, 10.0, 25.0, 40.0, 50.0]


@query("SELECT CASE WHEN l_quantity BETWEEN 0 AND 10 THEN 'b0' WHEN l_quantity <= 25 THEN 'b1' WHEN l_quantity <= 40 THEN 'b2' WHEN l_quantity <= 50 THEN 'b3' END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def binning(spark, sf_dir):
    binned = features.bin_column(F.col("l_quantity"), EDGES, ["b0", "b1", "b2", "b3"])
    return table(spark, sf_dir, "lineitem").groupBy(binned.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_tax, 6) AS l_quantity_multiply_l_tax, round(l_quantity / nullif(l_tax, 0), 6) AS l_quantity_divide_l_tax, round(pow(l_quantity, 2), 6) AS l_quantity_pow2 FROM lineitem")
def interaction_features(spark, sf_dir):
    chosen = [features.Interaction("l_quantity", "l_tax", op, 1.0) for op in ("multiply", "divide")]
    out = features.polynomial_columns(features.interaction_columns(table(spark, sf_dir, "lineitem"), chosen), [features.Polynomial("l_quantity", 2, 1.0)])
    return tidy(out.select(*LINE_KEY, "l_quantity_multiply_l_tax", "l_quantity_divide_l_tax", "l_quantity_pow2"))


@query(union("SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, CASE WHEN count(DISTINCT {c}) = 2 THEN 'label' WHEN count(DISTINCT {c}) <= 10 THEN 'one_hot' ELSE 'frequency' END AS encoding FROM lineitem", ["l_returnflag", "l_linestatus"]))
def encoding_rules(spark, sf_dir):
    return features.encoding_rules(table(spark, sf_dir, "lineitem"))


@query(union("SELECT '{c}' AS column_name, CASE WHEN min({c}) >= 0 AND max({c}) <= 1 THEN 'none' ELSE 'standard' END AS scaling FROM lineitem", MEASURES))
def scaling_rules(spark, sf_dir):
    return features.scaling_rules(table(spark, sf_dir, "lineitem"), MEASURES)


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal_scaled FROM customer")
def standard_scaling(spark, sf_dir):
    return tidy(features.scaled(table(spark, sf_dir, "customer"), "c_acctbal", "standard").select("c_custkey", "c_acctbal_scaled"))


@query("SELECT c_custkey, round(count(*) OVER (PARTITION BY c_mktsegment) / (count(*) OVER ())::DOUBLE, 6) AS c_mktsegment_frequency FROM customer")
def frequency_encoding(spark, sf_dir):
    return tidy(features.encoded(table(spark, sf_dir, "customer"), "c_mktsegment", "frequency").select("c_custkey", "c_mktsegment_frequency"))


@query(union("SELECT '{c}' AS column_name, CAST(min({c}) AS BIGINT) AS min, CAST(max({c}) AS BIGINT) AS max, CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint' ELSE 'int' END AS narrowest FROM orders", ["o_orderkey", "o_custkey"]))
def narrow_types(spark, sf_dir):
    return features.narrow_types(table(spark, sf_dir, "orders"))


@query("SELECT CAST(least(19, floor((o_totalprice - lo) / ((hi - lo) / 20))) AS BIGINT) AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1")
def histogram(spark, sf_dir):
    return charts.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 20).select("bin", "n")


@query(
    union(
        "SELECT '{c}' AS column_name, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3, min({c}) FILTER (WHERE {c} BETWEEN 2.5 * q1 - 1.5 * q3 AND 2.5 * q3 - 1.5 * q1) AS low_whisker, max({c}) FILTER (WHERE {c} BETWEEN 2.5 * q1 - 1.5 * q3 AND 2.5 * q3 - 1.5 * q1) AS high_whisker, count(*) FILTER (WHERE {c} NOT BETWEEN 2.5 * q1 - 1.5 * q3 AND 2.5 * q3 - 1.5 * q1) AS outliers "
        "FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM lineitem) GROUP BY q1, q2, q3",
        MEASURES,
    )
)
def box_plots(spark, sf_dir):
    return tidy(charts.box(table(spark, sf_dir, "lineitem"), MEASURES))


@query("SELECT o_orderpriority AS label, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 3")
def bar_chart(spark, sf_dir):
    return tidy(charts.bars(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", 3), 2)


@query()
def kernel_density(spark, sf_dir):
    return tidy(charts.density(table(spark, sf_dir, "customer"), "c_acctbal", 50), 9, x=6)


@query("SELECT n_name AS name, n_regionkey AS region, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def except_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey").distinct().subtract(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("SELECT lang, count(*) AS n, round(avg(length(text)), 4) AS mean_length, max(length(text)) AS max_length FROM documents GROUP BY lang")
def text_lengths(spark, sf_dir):
    return tidy(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean_length"), F.max(F.length("text")).cast("long").alias("max_length")), 4)


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def label_balance(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT turns, count(*) AS conversations FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) GROUP BY 1")
def conversation_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).groupBy("turns").agg(F.count(F.lit(1)).alias("conversations"))
