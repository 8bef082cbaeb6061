"""More registered queries: tests and their p-values, series diagnostics, recommendations, validation, files, the façade and charts.

p-values of SQL twins use the series of the normal distribution function, as DuckDB has no error function.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import ANOVA, DAILY, MEASURES, PLACED, RANKED, SQL, daily, day, query, rows, table, tidy, union
from .functions.shared import shared_folder
from .operators import anomaly, charts, correlation, descriptive, features, hypothesis, outliers, quality, timeseries, validators
from .plans.analyzer import EDA
from .plans.config import EDAConfig, preset
from .sources import formatters
from .sources.loader import DataLoader


def phi(z: str) -> str:
    """Distribution function of the standard normal, for |z| up to about 6."""
    terms = f"list_transform(range(0, 90), lambda k: pow({z}, 2 * k + 1) * sqrt(pi()) / (pow(2, k + 1) * gamma(k + 1.5)))"
    return f"CASE WHEN {z} < -6 THEN 0.0 WHEN {z} > 6 THEN 1.0 ELSE 0.5 + exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum({terms}) END"


def level(v: str, bounds: tuple[float, float, float]) -> str:
    a, b, c = bounds
    return f"CASE WHEN abs({v}) >= {c} THEN 'large' WHEN abs({v}) >= {b} THEN 'medium' WHEN abs({v}) >= {a} THEN 'small' ELSE 'negligible' END"


# Hypothesis tests --------------------------------------------------------------------------------

_STATUS = "(SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O'))"
_U = (
    RANKED.format(g="o_orderstatus", v="o_totalprice", t=_STATUS)
    + ", p AS (SELECT a.n AS n, b.n AS m, a.s - a.n * (a.n + 1) / 2.0 AS u, (SELECT t FROM tie) AS t FROM s a, s b WHERE a.g = 'F' AND b.g = 'O'), "
    "z AS (SELECT *, (abs(u - n * m / 2.0) - 0.5) / sqrt(n * m / 12.0 * ((n + m + 1) - t / ((n + m)::DOUBLE * (n + m - 1)))) AS z FROM p) "
)


@query(_U + f"SELECT round(u, 1) AS u, round(least(1.0, 2 * (1 - {phi('z')})), 5) AS p_value, round(1 - 2 * u / (n::DOUBLE * m), 6) AS rank_biserial, {level('(1 - 2 * u / (n::DOUBLE * m))', (0.1, 0.3, 0.5))} AS effect FROM z")
def mann_whitney_test(spark, sf_dir):
    r = hypothesis.mann_whitney(table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')"), "o_totalprice", "o_orderstatus")
    return tidy(rows(spark, [r | {"u": float(r["u"])}], "u double, p_value double, rank_biserial double, effect string"), u=1, p_value=5)


@query(
    f"WITH w AS ({SQL['signed_ranks']}), z AS (SELECT *, least(w_plus, w_minus) AS w, abs(least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w) "
    f"SELECT round(w, 1) AS w, n, round(least(1.0, 2 * (1 - {phi('z')})), 5) AS p_value FROM z"
)
def wilcoxon_test(spark, sf_dir):
    r = hypothesis.wilcoxon(table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25.0).alias("d")), "d")
    return tidy(rows(spark, [r | {"w": float(r["w"])}], "w double, n long, p_value double"), w=1, p_value=5)


_TWO = "WITH t AS (SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS w, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS x, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS y, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS z FROM labels)"
_CHOOSE = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"


def _log_p(k: str) -> str:
    return f"({_CHOOSE.format(n='(w + x)', k=k)}) + ({_CHOOSE.format(n='(y + z)', k=f'(w + y - {k})')}) - ({_CHOOSE.format(n='(w + x + y + z)', k='(w + y)')})"


@query(
    _TWO + f", k AS (SELECT *, unnest(generate_series(greatest(0, w - z), least(w + x, w + y))) AS k FROM t), p AS (SELECT *, {_log_p('k')} AS l, {_log_p('w')} AS l0 FROM k) "
    "SELECT round(max(w)::DOUBLE * max(z) / (max(x)::DOUBLE * max(y)), 6) AS odds_ratio, round(least(1.0, sum(CASE WHEN l <= l0 + 1e-7 THEN exp(l) ELSE 0 END)), 6) AS p_value FROM p"
)
def fisher_test(spark, sf_dir):
    r = hypothesis.fisher_exact(table(spark, sf_dir, "labels"), "quality", "toxic")
    return tidy(rows(spark, [{k: float(r[k]) for k in ("odds_ratio", "p_value")}], "odds_ratio double, p_value double"))


@query(_TWO + f", c AS (SELECT x AS b, y AS c, pow(abs(x - y) - 1, 2) / (x + y)::DOUBLE AS chi2 FROM t) SELECT b, c, round(chi2, 6) AS chi2, round(2 * (1 - {phi('sqrt(chi2)')}), 6) AS p_chi2 FROM c")
def mcnemar_test(spark, sf_dir):
    r = hypothesis.mcnemar(table(spark, sf_dir, "labels"), "quality", "toxic")
    return tidy(rows(spark, [r | {"chi2": float(r["chi2"]), "p_chi2": float(r["p_chi2"])}], "b long, c long, chi2 double, p_chi2 double"))


_GROUP = "SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1"


@query(
    f"WITH g AS ({_GROUP}), p AS (SELECT a.m - b.m AS d, a.n AS n, b.n AS k, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS v FROM g a, g b WHERE a.g = 'F' AND b.g = 'O') "
    f"SELECT round(d / sqrt(v * (1.0 / n + 1.0 / k)), 6) AS t, round(d / sqrt(v), 6) AS cohens_d, {level('(d / sqrt(v))', (0.2, 0.5, 0.8))} AS effect FROM p"
)
def two_sample_t(spark, sf_dir):
    return tidy(rows(spark, [hypothesis.t_test(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus")], "t double, cohens_d double, effect string"))


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS measure, round(v, 6) AS value, {level('v', bounds)} AS effect FROM (SELECT {column} AS v FROM ({SQL[source]}))"
        for name, column, source, bounds in (("eta_squared", "eta_squared", "anova", (0.01, 0.06, 0.14)), ("cramers_v", "cramers_v", "chi_square_statistic", (0.1, 0.3, 0.5)), ("epsilon_squared", "epsilon_squared", "kruskal_statistic", (0.01, 0.08, 0.26)))
    )
)
def effect_sizes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = {
        "eta_squared": hypothesis.one_way_anova(orders, "o_totalprice", "o_orderpriority"), "cramers_v": hypothesis.chi_square(orders, "o_orderstatus", "o_orderpriority"),
        "epsilon_squared": hypothesis.kruskal_wallis(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag"),
    }
    return tidy(rows(spark, [{"measure": k, "value": r[k], "effect": r["effect"]} for k, r in found.items()], "measure string, value double, effect string"))


_PRIORITY = "SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1"


@query(
    f"WITH g AS ({_PRIORITY}), e AS (SELECT sum((n - 1) * v) / sum(n - 1) AS mse FROM g) SELECT a.g AS group1, b.g AS group2, round(b.m - a.m, 4) AS mean_difference, round(abs(b.m - a.m) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)), 4) AS q FROM g a JOIN g b ON a.g < b.g, e"
)
def tukey_statistics(spark, sf_dir):
    found = hypothesis.tukey_hsd(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")
    return tidy(rows(spark, found, "group1 string, group2 string, mean_difference double, q double"), 4)


_CELLS = "SELECT l_returnflag AS a, l_linestatus AS b, l_quantity AS v, (l_linestatus = 'O')::DOUBLE AS x FROM lineitem"


@query(
    f"WITH c AS ({_CELLS}), full_ AS (SELECT sum(q) AS r, count(*) AS k, sum(n) AS n FROM (SELECT count(*) AS n, var_pop(v) * count(*) AS q FROM c GROUP BY a, b)), only_a AS (SELECT sum(q) AS r FROM (SELECT var_pop(v) * count(*) AS q FROM c GROUP BY a)), only_b AS (SELECT sum(q) AS r FROM (SELECT var_pop(v) * count(*) AS q FROM c GROUP BY b)), "
    "w AS (SELECT v - avg(v) OVER (PARTITION BY a) AS y, x - avg(x) OVER (PARTITION BY a) AS x FROM c), m AS (SELECT pow(sum(x * y), 2) / sum(x * x) AS ss_b FROM w), "
    "t AS (SELECT 'l_returnflag' AS term, only_b.r - (only_a.r - ss_b) AS ss, 2 AS df FROM only_a, only_b, m UNION ALL SELECT 'l_linestatus', ss_b, 1 FROM m UNION ALL SELECT 'l_returnflag:l_linestatus', only_a.r - ss_b - full_.r, 2 FROM only_a, m, full_) "
    "SELECT term, round(ss, 3) AS ss, CAST(df AS BIGINT) AS df, round(ss / df / (r / (n - k)), 4) AS f FROM t, full_ UNION ALL SELECT 'residual', round(r, 3), CAST(n - k AS BIGINT), NULL FROM full_"
)
def two_way_sums(spark, sf_dir):
    """The second factor has two levels, so within the first one's levels its effect is a regression on one number."""
    found = hypothesis.two_way_anova(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus")
    return tidy(rows(spark, [r | {"ss": float(r["ss"]), "f": None if r["f"] is None else float(r["f"])} for r in found], "term string, ss double, df long, f double"), ss=3, f=4)


_G1 = f"WITH d AS (SELECT period, value AS y, n::DOUBLE AS x FROM ({DAILY})), l AS (SELECT y, lag(y) OVER w AS y1, lag(x) OVER w AS x1 FROM d WINDOW w AS (ORDER BY period)), c AS (SELECT count(*) AS n, corr(y, x1) AS a, corr(y, y1) AS b, corr(x1, y1) AS c FROM l WHERE y1 IS NOT NULL), r AS (SELECT n, pow(a - b * c, 2) / ((1 - b * b) * (1 - c * c)) AS r FROM c) "


@query(_G1 + "SELECT CAST(1 AS BIGINT) AS lag, round(r / (1 - r) * (n - 3), 4) AS f, round(n * r / (1 - r), 4) AS chi2, round(-n * ln(1 - r), 4) AS lr FROM r")
def granger_first_lag(spark, sf_dir):
    d = daily(spark, sf_dir).select("period", "value", F.col("n").cast("double").alias("orders"))
    found = hypothesis.granger(d, "period", "value", "orders", 1)["lags"]
    return tidy(rows(spark, [{k: float(v) if k != "lag" else v for k, v in r.items()} for r in found], "lag long, f double, chi2 double, lr double"), 4)


_M = "SELECT count(v) AS n, avg(v) AS m, stddev_samp(v) AS s, stddev_pop(v) AS p FROM b"
_K2 = (
    "k AS (SELECT n::DOUBLE AS n, g, k, g * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y, 3.0 * (n::DOUBLE * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) AS be FROM mo), "
    "k1 AS (SELECT *, sqrt(2 * (be - 1)) - 1 AS w2, 3 * (n - 1) / (n + 1) AS mean_, 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS var_, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS th FROM k), "
    "k2 AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs, (k + 3 - mean_) / sqrt(var_) AS x, 6 + 8 / th * (2 / th + sqrt(1 + 4 / (th * th))) AS a FROM k1), "
    "k3 AS (SELECT *, 1 + x * sqrt(2 / (a - 4)) AS de FROM k2), k4 AS (SELECT zs * zs + pow(((1 - 2 / (9 * a)) - sign(de) * pow(abs((1 - 2 / a) / de), 1 / 3.0)) / sqrt(2 / (9 * a)), 2) AS k2 FROM k3)"
)


@query(
    f"WITH b AS (SELECT c_acctbal AS v FROM customer), m AS ({_M}), mo AS (SELECT n, sum(pow(v - m, 3)) / n / pow(p, 3) AS g, sum(pow(v - m, 4)) / n / pow(p, 4) - 3 AS k FROM b, m GROUP BY n, p), {_K2}, "
    f"r AS (SELECT v, (v - m) / s AS z, count(*) AS t, n FROM b, m GROUP BY v, m, s, n), c AS (SELECT *, {phi('z')} AS f, sum(t) OVER (ORDER BY v) AS upto FROM r), "
    "q AS (SELECT max(greatest(upto / n::DOUBLE - f, f - (upto - t) / n::DOUBLE)) AS d, -max(n) - sum(t * (2 * (upto - (t - 1) / 2.0) - 1) * ln(f) + t * (2 * (n - (upto - (t - 1) / 2.0)) + 1) * ln(1 - f)) / max(n) AS a2, max(n) AS n FROM c) "
    "SELECT 'ks' AS test, round(d, 6) AS statistic FROM q UNION ALL SELECT 'anderson', round(a2, 3) FROM q UNION ALL SELECT 'critical', round(0.787 / (1 + 4.0 / n - 25.0 / (n::DOUBLE * n)), 6) FROM q UNION ALL SELECT 'dagostino', round(k2, 4) FROM k4 UNION ALL SELECT 'dagostino_p', round(exp(-k2 / 2), 6) FROM k4"
)
def normality_statistics(spark, sf_dir):
    r = hypothesis.normality(table(spark, sf_dir, "customer"), "c_acctbal", shapiro_limit=0)
    found = {"ks": round(r["ks"]["d"], 6), "anderson": round(r["anderson"]["a2"], 3), "critical": round(r["anderson"]["critical_5"], 6), "dagostino": round(r["dagostino"]["k2"], 4), "dagostino_p": round(r["dagostino"]["p_value"], 6)}
    return rows(spark, [{"test": k, "statistic": float(v)} for k, v in found.items()], "test string, statistic double")


_PAIRS = [("o_orderkey", "o_custkey"), ("o_orderkey", "o_totalprice"), ("o_custkey", "o_totalprice")]


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(r, 6) AS r, round(2 * (1 - {phi('z')}), 2) AS p_value, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM (SELECT r, abs(r) * sqrt((n - 2) / (1 - r * r)) AS z FROM (SELECT corr({a}, {b}) AS r, count(*) AS n FROM orders))"
        for a, b in _PAIRS
    )
)
def correlation_p_values(spark, sf_dir):
    """With thousands of rows Student's t is the normal distribution to the digits compared."""
    found = correlation.pearson(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"]).collect()
    return tidy(rows(spark, [{"feature1": r.feature1, "feature2": r.feature2, "r": r.r, "p_value": correlation.pair_p_value(r.r, r.n), "direction": "positive" if r.r > 0 else "negative"} for r in found], "feature1 string, feature2 string, r double, p_value double, direction string"), p_value=2)


# Anomalies over all neighbours ---------------------------------------------------------------------

_LOF = (
    "WITH p AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS id, s_suppkey, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier), n AS (SELECT a.id, b.id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id) AS k FROM p a JOIN p b ON a.id <> b.id), "
    "near AS (SELECT * FROM n WHERE k <= 20), reach AS (SELECT id, max(d) AS kd FROM near GROUP BY id), dens AS (SELECT n.id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM near n JOIN reach r ON r.id = n.other GROUP BY n.id), "
    "lof AS (SELECT n.id, avg(o.lrd) / max(d.lrd) AS f FROM near n JOIN dens o ON o.id = n.other JOIN dens d ON d.id = n.id GROUP BY n.id) "
)


#: Twins of queries of the first catalog, over all pairs of rows.
SQL["local_outlier_factor"] = _LOF + "SELECT s_suppkey, round(f, 4) AS anomaly_score, f > (SELECT quantile_disc(f, 0.9) FROM lof) AS is_anomaly FROM lof JOIN p USING (id)"


@query(_LOF + "SELECT s_suppkey, round(f, 4) AS anomaly_score FROM lof JOIN p USING (id)")
def outlier_factors(spark, sf_dir):
    return tidy(anomaly.local_outlier_factor(table(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_acctbal", "s_nationkey"]).select("s_suppkey", "anomaly_score"), 4)


_DBSCAN = (
    "WITH p AS (SELECT s_suppkey AS id, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS x, (s_nationkey - avg(s_nationkey) OVER ()) / stddev_pop(s_nationkey) OVER () AS y FROM supplier), "
    "n AS (SELECT a.id, b.id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS k FROM p a JOIN p b ON a.id <> b.id), "
    "e AS (SELECT {eps} AS e), core AS (SELECT id FROM n, e WHERE d <= e GROUP BY id HAVING count(*) >= 4), c AS (SELECT id, min(d) AS d FROM n WHERE other IN (SELECT id FROM core) GROUP BY id) "
    "SELECT p.id AS s_suppkey, CASE WHEN p.id IN (SELECT id FROM core) OR coalesce(d <= e, false) THEN 0.0 ELSE round(coalesce(d, 'inf'::DOUBLE), 5) END AS anomaly_score, NOT (p.id IN (SELECT id FROM core) OR coalesce(d <= e, false)) AS is_anomaly FROM e, p LEFT JOIN c USING (id)"
)
SQL["dbscan_noise"] = _DBSCAN.format(eps="(SELECT quantile_cont(d, 0.9) FROM n WHERE k = 4)")


@query(_DBSCAN.format(eps="0.3"))
def dbscan_radius(spark, sf_dir):
    return tidy(anomaly.dbscan(table(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_acctbal", "s_nationkey"], eps=0.3, min_samples=5), 5)


@query("SELECT count(*) AS n_scored, CAST(count(*) AS BIGINT) AS n_within, true AS few_flagged FROM customer")
def forest_summary(spark, sf_dir):
    """The scores are of seeded random trees; what holds for any of them is counted: all rows scored, scores in (0, 1), at most a tenth flagged."""
    scored = anomaly.isolation_forest(table(spark, sf_dir, "customer"), ["c_custkey"], ["c_acctbal", "c_nationkey"])
    return scored.agg(F.count(F.lit(1)).alias("n_scored"), F.count_if((F.col("anomaly_score") > 0) & (F.col("anomaly_score") < 1)).alias("n_within"), (F.count_if("is_anomaly") <= 0.1 * F.count(F.lit(1))).alias("few_flagged"))


@query("SELECT 1000::BIGINT AS n, 1000::BIGINT AS n_distinct, 1000::BIGINT AS n_known FROM (SELECT count(*) AS c FROM orders) WHERE c >= 1000")
def random_sample_counts(spark, sf_dir):
    """Which rows a random sample holds is the hash's choice; that it holds as many as asked for, each once and of the table, is not."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    sample = features.random_sample(orders, 1000, ["o_orderkey"])
    known = sample.join(orders, "o_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("n_known"))
    return sample.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_distinct")).crossJoin(F.broadcast(known))  # one row


@query("SELECT o_orderkey, round(abs(o_totalprice - m) / s, 6) AS anomaly_score, abs(o_totalprice - m) / s > 2.0 AS is_anomaly FROM orders, (SELECT median(o_totalprice) AS m, mad(o_totalprice) / 0.6745 AS s FROM orders)")
def deviation_scores(spark, sf_dir):
    return tidy(outliers.score_rows(table(spark, sf_dir, "orders"), "o_totalprice", "modified_zscore", 2.0).select("o_orderkey", "anomaly_score", "is_anomaly"))


# Time series -----------------------------------------------------------------------------------------


@query(f"SELECT round(regr_slope(value, s) * 1e6, 4) AS slope, round(regr_intercept(value, s), 3) AS intercept FROM (SELECT value, epoch(period) - min(epoch(period)) OVER () AS s FROM ({DAILY}))")
def time_line(spark, sf_dir):
    return tidy(timeseries.time_trend(daily(spark, sf_dir), "period", "value").withColumn("slope", F.col("slope") * 1e6), slope=4, intercept=3)


@query(
    f"WITH m AS ({SQL['mann_kendall_s']}), z AS (SELECT s, (s - sign(s)) / sqrt(n::DOUBLE * (n - 1) * (2 * n + 5) / 18) AS z FROM m), p AS (SELECT s, z, 2 * (1 - {phi('abs(z)')}) AS p FROM z) "
    "SELECT s, round(z, 5) AS z, round(p, 5) AS p_value, CASE WHEN p >= 0.05 THEN 'no trend' WHEN z > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM p"
)
def mann_kendall_test(spark, sf_dir):
    r = timeseries.mann_kendall(daily(spark, sf_dir), "period", "value")
    return tidy(rows(spark, [r | {"z": float(r["z"]), "p_value": float(r["p_value"])}], "s long, z double, p_value double, trend string"), 5)


_ACF = f"WITH a AS ({SQL['autocorrelations'].replace('round(sum(d * e) / max(s), 6)', 'sum(d * e) / max(s)')}), n AS (SELECT count(*) AS n FROM ({DAILY}))"


@query(_ACF + " SELECT lag, round(sum(n::DOUBLE * (n + 2) * acf * acf / (n - lag)) OVER (ORDER BY lag), 4) AS q FROM a, n WHERE lag > 0")
def ljung_box_statistics(spark, sf_dir):
    return tidy(rows(spark, timeseries.ljung_box(daily(spark, sf_dir), "period", "value", 5), "lag long, q double"), 4)


@query(
    _ACF + ", r AS (SELECT lag, acf * n / (n - lag)::DOUBLE AS r FROM a, n), x AS (SELECT max(CASE WHEN lag = 1 THEN r END) AS r1, max(CASE WHEN lag = 2 THEN r END) AS r2 FROM r) "
    "SELECT CAST(0 AS BIGINT) AS lag, 1.0 AS pacf UNION ALL SELECT 1, round(r1, 6) FROM x UNION ALL SELECT 2, round((r2 - r1 * r1) / (1 - r1 * r1), 6) FROM x"
)
def partial_autocorrelations(spark, sf_dir):
    found = timeseries.acf_pacf(daily(spark, sf_dir), "period", "value", 2)["pacf"]
    return tidy(rows(spark, [{"lag": k, "pacf": float(v)} for k, v in enumerate(found)], "lag long, pacf double"))


@query(f"WITH x AS (SELECT CAST(i % 7 AS VARCHAR) AS g, v FROM ({PLACED})) " + ANOVA.format(g="g", v="v", t="x", r="round").replace("WITH g AS", ", g AS").replace("round(b, 0)", "round(b / 1e6, 2)").replace("round(w, 0)", "round(w / 1e6, 0)").replace("eta_squared FROM", "eta_squared FROM").replace("k AS groups, n, round(b / 1e6, 2) AS ss_between, round(w / 1e6, 0) AS ss_within,", "k AS groups, n,"))
def seasonality_anova(spark, sf_dir):
    r = timeseries.seasonality_test(daily(spark, sf_dir), "period", "value", 7)
    return tidy(rows(spark, [r], "groups long, n long, f double, eta_squared double"), f=5)


_STRENGTH = "least(1.0, greatest(0.0, var_samp({c}) / (var_samp({c}) + var_samp(v - {c}))))"


@query(
    "WITH d AS (" + SQL["classical_decomposition"].split(" SELECT CAST(i AS BIGINT)")[0].removeprefix("WITH ").join(["SELECT * FROM (WITH ", " SELECT v, trend, seasonal, v - trend - seasonal AS residual FROM t JOIN c ON t.i % 7 = c.phase)"]) + ") "
    + f"SELECT round({_STRENGTH.format(c='trend')}, 5) AS trend_strength, round({_STRENGTH.format(c='seasonal')}, 5) AS seasonal_strength FROM d"
)
def component_strengths(spark, sf_dir):
    parts = timeseries.decompose(daily(spark, sf_dir), "period", "value", 7)
    return tidy(timeseries.component_strength(parts).select("trend_strength", "seasonal_strength"), 5)


_V = f"WITH v AS (SELECT i, v, count(*) OVER () AS n FROM ({PLACED})), l AS (SELECT regr_slope(v, i) AS a, regr_intercept(v, i) AS b FROM v)"


@query(
    _V + ", d AS (SELECT i, n, v - a * i - b AS d FROM v, l), f AS (SELECT unnest(range(1, CAST(max(n) // 2 + 1 AS BIGINT))) AS k FROM d), w AS (SELECT k, max(n) AS n, pow(sum(d * cos(2 * pi() * k * i / n)), 2) + pow(sum(d * sin(2 * pi() * k * i / n)), 2) AS p FROM d, f GROUP BY k), "
    "b AS (SELECT CAST(floor(n / k::DOUBLE) AS BIGINT) AS period, n FROM w ORDER BY p DESC LIMIT 1) SELECT CASE WHEN period >= 2 AND period <= n // 2 THEN period END AS period FROM b"
)
def detected_period(spark, sf_dir):
    import numpy as np

    v = [r.v for r in timeseries.series(daily(spark, sf_dir), "period", "value").orderBy("t", "v").collect()]  # one series, as its spectrum needs
    return rows(spark, [{"period": timeseries.detect_period(np.array(v))}], "period long")


@query(
    f"WITH v AS (SELECT v, lag(v) OVER (ORDER BY i) AS b FROM ({PLACED})), r AS (SELECT regr_slope(v - b, b) AS s, regr_r2(v - b, b) AS r2, regr_syy(v - b, b) AS yy, regr_sxx(v - b, b) AS xx, count(b) AS n FROM v WHERE b IS NOT NULL) SELECT round(s / sqrt((1 - r2) * yy / ((n - 2) * xx)), 4) AS statistic FROM r"
)
def dickey_fuller(spark, sf_dir):
    import numpy as np

    v = [r.v for r in timeseries.series(daily(spark, sf_dir), "period", "value").orderBy("t", "v").collect()]
    return tidy(rows(spark, [{"statistic": float(timeseries.adf(np.array(v), 0)["statistic"])}], "statistic double"), 4)


@query(
    f"WITH v AS (SELECT i, v - avg(v) OVER () AS e, count(*) OVER () AS n FROM ({PLACED})), c AS (SELECT sum(pow(s, 2)) AS s2, max(n) AS n FROM (SELECT n, sum(e) OVER (ORDER BY i) AS s FROM v)), k AS (SELECT unnest(range(1, CAST(least(ceil(12 * pow(n / 100.0, 0.25)), n - 1) AS BIGINT) + 1)) AS k FROM c), "
    "a AS (SELECT sum((1 - k / (least(ceil(12 * pow(x.n / 100.0, 0.25)), x.n - 1) + 1)) * x.e * y.e) AS a FROM v x JOIN k ON true JOIN v y ON y.i = x.i + k.k), z AS (SELECT sum(e * e) AS z FROM v) SELECT round(s2 / (n * (z + 2 * a)), 5) AS statistic FROM c, a, z"
)
def kpss_statistic(spark, sf_dir):
    import numpy as np

    v = [r.v for r in timeseries.series(daily(spark, sf_dir), "period", "value").orderBy("t", "v").collect()]
    return tidy(rows(spark, [{"statistic": timeseries.kpss(np.array(v))["statistic"]}], "statistic double"), 5)


@query("WITH t AS (SELECT DISTINCT date_trunc('hour', ts) AS t FROM events), s AS (SELECT epoch(t) - epoch(lag(t) OVER (ORDER BY t)) AS s FROM t) SELECT CASE WHEN min(s) = max(s) THEN CASE WHEN min(s) = 3600 THEN 'H' END END AS frequency FROM s")
def hourly_frequency(spark, sf_dir):
    hours = table(spark, sf_dir, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("t"))
    found = timeseries.frequency(hours, "t")
    return rows(spark, [{"frequency": found if found == "H" else None}], "frequency string")


@query(f"SELECT count(*) AS length, strftime(min(period), '%Y-%m-%d') AS first_day, strftime(max(period), '%Y-%m-%d') AS last_day, count(*) - count(value) AS missing FROM ({DAILY})")
def series_facts(spark, sf_dir):
    facts = timeseries.basic_info(daily(spark, sf_dir), "period", "value")
    return day(day(facts.select("length", F.col("start").alias("first_day"), F.col("end").alias("last_day"), "missing"), "first_day"), "last_day")


# Features ----------------------------------------------------------------------------------------------


@query("SELECT population, CAST(ceil(n0 / (1 + (n0 - 1) / population)) AS BIGINT) AS n FROM (SELECT unnest([100, 10000, 1000000]) AS population, pow(1.959963984540054, 2) * 0.25 / pow(0.05, 2) AS n0)")
def sample_sizes(spark, sf_dir):
    return rows(spark, [{"population": n, "n": features.sample_size(n)} for n in (100, 10_000, 1_000_000)], "population int, n long")


@query(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, 'multiply' AS operation, round(abs(corr({a}, {b})), 6) AS score FROM orders WHERE true HAVING abs(corr({a}, {b})) > 0.0005" for a, b in _PAIRS)
    + " UNION ALL " + " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, 'divide' AS operation, round(r / (r + o), 6) AS score FROM (SELECT var_samp({a} / {b}::DOUBLE) AS r, var_samp({a}) AS o, count(*) FILTER (WHERE {b} = 0) AS z FROM orders) WHERE z = 0 AND r > 0.5 * o" for a, b in _PAIRS) + ")"
)
def detected_interactions(spark, sf_dir):
    found = features.detect_interactions(table(spark, sf_dir, "orders"), correlation=0.0005)
    return tidy(rows(spark, [vars(f) for f in found], "feature1 string, feature2 string, operation string, score double"))


@query("SELECT 'p' AS feature, CAST(2 AS BIGINT) AS degree, round(abs(s) + abs(k) / 3, 6) AS score FROM (SELECT sum(pow(p - m, 3)) / count(*) / pow(max(d), 3) AS s, sum(pow(p - m, 4)) / count(*) / pow(max(d), 4) - 3 AS k FROM (SELECT p, avg(p) OVER () AS m, stddev_pop(p) OVER () AS d FROM (SELECT pow(l_quantity / 10, 6) AS p FROM lineitem))) WHERE abs(s) > 1 OR abs(k) > 3")
def detected_polynomials(spark, sf_dir):
    found = features.detect_polynomials(table(spark, sf_dir, "lineitem").select(F.pow(F.col("l_quantity") / 10, F.lit(6)).alias("p")))
    return tidy(rows(spark, [vars(f) for f in found], "feature string, degree long, score double"))


@query(
    "WITH s AS (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3, stddev_samp(o_totalprice) AS s FROM orders), "
    "b AS (SELECT *, greatest(3, least(20, list_sort([ceil(log2(n) + 1), ceil((hi - lo) / (2 * (q3 - q1) / pow(n, 1 / 3.0))), ceil((hi - lo) / (3.5 * s / pow(n, 1 / 3.0)))])[2])) AS k FROM s) "
    "SELECT 'uniform' AS strategy, i AS edge, round(lo + (hi - lo) * i / k, 4) AS value FROM (SELECT *, unnest(range(0, CAST(k AS BIGINT) + 1)) AS i FROM b)"
)
def recommended_bins(spark, sf_dir):
    (found,) = features.recommend_binning(table(spark, sf_dir, "orders"), ["o_totalprice"])
    return tidy(rows(spark, [{"strategy": found.strategy, "edge": i, "value": float(e)} for i, e in enumerate(found.edges)], "strategy string, edge long, value double"), 4)


@query("SELECT c_custkey, row_number_ AS c_mktsegment_label FROM customer JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS row_number_ FROM (SELECT DISTINCT c_mktsegment FROM customer)) USING (c_mktsegment)")
def label_encoding(spark, sf_dir):
    return features.encoded(table(spark, sf_dir, "customer"), "c_mktsegment", "label").select("c_custkey", F.col("c_mktsegment_label").cast("long"))


@query("SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 4) AS c_mktsegment_target FROM customer")
def target_encoding(spark, sf_dir):
    return tidy(features.encoded(table(spark, sf_dir, "customer"), "c_mktsegment", "target", "c_acctbal").select("c_custkey", "c_mktsegment_target"), 4)


@query("SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT AS l_returnflag_A, (l_returnflag = 'N')::INT AS l_returnflag_N, (l_returnflag = 'R')::INT AS l_returnflag_R FROM lineitem")
def one_hot_encoding(spark, sf_dir):
    return features.encoded(table(spark, sf_dir, "lineitem"), "l_returnflag", "one_hot").select("l_orderkey", "l_linenumber", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R")


@query(
    "SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS minmax, round((c_acctbal - m) / (q3 - q1), 6) AS robust, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS logarithm "
    "FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer)"
)
def other_scalings(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    for how, name in (("minmax", "minmax"), ("robust", "robust"), ("log", "logarithm")):
        df = features.scaled(df, "c_acctbal", how).withColumnRenamed("c_acctbal_scaled", name)
    return tidy(df.drop("c_acctbal"))


@query(
    "WITH p AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), j AS (SELECT CAST(floor(g * (SELECT max(n) FROM p) / 500) AS BIGINT) AS i FROM (SELECT unnest(range(500)) AS g)), s AS (SELECT avg(v) AS m FROM p WHERE i IN (SELECT i FROM j)) "
    "SELECT 'o_totalprice' AS column_name, round(avg(v), 4) AS mean, round(max(m), 4) AS sample_mean, round(abs(avg(v) - max(m)) / stddev_samp(v), 6) AS difference, abs(avg(v) - max(m)) / stddev_samp(v) <= 0.1 AS representative FROM p, s"
)
def sample_means(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    sample = features.systematic_sample(orders, 500, ["o_orderkey"])
    return tidy(features.representativeness(orders, sample, ["o_totalprice"]), mean=4, sample_mean=4)


@query(SQL["profile_numeric"])
def profile_by_ranges(spark, sf_dir):
    """The profile with percentiles that no task holds all values for."""
    return tidy(descriptive.describe_numeric(table(spark, sf_dir, "lineitem"), MEASURES, accuracy="ranged"), variance=4)


@query(SQL["modified_zscore_outliers"])
def outliers_by_ranges(spark, sf_dir):
    return tidy(outliers.outliers(table(spark, sf_dir, "lineitem"), "modified_zscore", columns=MEASURES, accuracy="ranged"), lower=4, upper=4)


# Validation, files, façade -------------------------------------------------------------------------------

_SCHEMA = {"o_orderkey": {"type": "numeric", "nullable": False}, "o_totalprice": {"type": "numeric", "min_value": 1000, "max_value": 200000}, "o_orderstatus": {"type": "string", "allowed_values": ["F", "O"]}, "o_clerk": {"type": "string"}}


@query(
    "SELECT 'o_clerk: required column is absent' AS error UNION ALL SELECT 'o_totalprice: ' || count(*) || ' rows break range' FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 200000 HAVING count(*) > 0 "
    "UNION ALL SELECT 'o_orderstatus: ' || count(*) || ' rows break allowed' FROM orders WHERE o_orderstatus NOT IN ('F', 'O') HAVING count(*) > 0"
)
def schema_errors(spark, sf_dir):
    _, errors = validators.validate_schema(table(spark, sf_dir, "orders"), _SCHEMA, strict=False)
    return rows(spark, [{"error": e} for e in errors], "error string")


@query("SELECT 'rows' AS description, count(*) >= 1000000000 AS valid, CASE WHEN count(*) < 1000000000 THEN count(*) || ' rows, fewer than 1000000000' ELSE '' END AS errors FROM orders UNION ALL SELECT 'columns', false, '6 columns, fewer than 7' UNION ALL SELECT 'missing', true, '' UNION ALL SELECT 'own', false, 'own: boom'")
def all_checks(spark, sf_dir):
    def broken(df):
        raise ValueError("boom")

    checks = [(validators.validate_table, {"min_rows": 10**9}, "rows"), (validators.validate_table, {"min_columns": 7}, "columns"), (validators.validate_table, {"max_missing_rate": 0.5}, "missing"), (broken, {}, "own")]
    found = validators.validate_all(table(spark, sf_dir, "orders"), checks)
    return rows(spark, [{"description": k, "valid": r["valid"], "errors": "; ".join(r["errors"])} for k, r in found["results"].items()], "description string, valid boolean, errors string")


@query("WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount) SELECT CAST(sum(n - 1) AS BIGINT) AS beyond_first, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS repeated FROM g")
def duplicate_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    count = lambda keep: validators.duplicate_count(lines, ["l_quantity", "l_discount"], keep)
    return rows(spark, [{"beyond_first": count("first"), "repeated": count("none")}], "beyond_first long, repeated long")


@query("SELECT 'absent' AS finding, 'o_clerk' AS columns UNION ALL SELECT 'not numeric', 'o_orderstatus' UNION ALL SELECT 'not datetime', 'o_custkey' UNION ALL SELECT 'not categorical', 'o_orderkey'")
def column_checks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = {
        "absent": validators.missing_columns(orders, ["o_orderkey", "o_clerk"]), "not numeric": validators.wrong_type(orders, ["o_totalprice", "o_orderstatus"], "numeric"),
        "not datetime": validators.wrong_type(orders, ["o_orderdate", "o_custkey"], "datetime"), "not categorical": validators.wrong_type(orders, ["o_orderkey", "o_orderstatus"], "categorical"),
    }
    return rows(spark, [{"finding": k, "columns": ",".join(v)} for k, v in found.items()], "finding string, columns string")


@query(
    "SELECT 'text' AS column_name, 'space_around' AS issue, 'low' AS severity, count(*) AS n FROM part WHERE p_size % 10 = 0 UNION ALL SELECT 'text', 'case_inconsistent', 'low', NULL WHERE false UNION ALL SELECT 'price', 'infinite_values', 'high', count(*) FROM part WHERE p_size = 1 "
    "UNION ALL SELECT 'price', 'unexpected_negative', 'medium', count(*) FROM part WHERE p_size = 2"
)
def consistency_findings(spark, sf_dir):
    price = F.when(F.col("p_size") == 1, float("inf")).when(F.col("p_size") == 2, -1.0).otherwise(F.col("p_retailprice"))
    made = table(spark, sf_dir, "part").select(price.alias("price"), F.when(F.col("p_size") % 10 == 0, F.lit(" a ")).otherwise("a").alias("text"))
    found = quality.consistency_issues(made)
    renamed = F.when(F.col("issue").startswith("unexpected"), "unexpected_negative").otherwise(F.col("issue"))
    return found.select("column_name", renamed.alias("issue"), "severity", F.col("n").cast("long").alias("n"))


def _through_a_file(spark, df: DataFrame, kind: str) -> DataFrame:
    """df written to the shared folder in a format and loaded again."""
    path = f"{shared_folder(spark)}/loaded-{uuid.uuid4().hex}.{kind}"
    writer = df.write.option("header", True)
    getattr(writer, {"csv": "csv", "json": "json", "parquet": "parquet", "orc": "orc"}[kind])(path)
    options = {"multiline": False} if kind == "json" else {}
    return DataLoader(spark).load(path, **options)


_BALANCES = "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier"


def _balances(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("s_suppkey").cast("long"), "s_name", F.col("s_nationkey").cast("int"), F.col("s_acctbal").cast("double"))


@query(_BALANCES)
def loaded_csv(spark, sf_dir):
    return _typed(_through_a_file(spark, _balances(spark, sf_dir), "csv"))


@query(_BALANCES)
def loaded_json(spark, sf_dir):
    return _typed(_through_a_file(spark, _balances(spark, sf_dir), "json"))


@query(_BALANCES)
def loaded_parquet(spark, sf_dir):
    return _typed(_through_a_file(spark, _balances(spark, sf_dir), "parquet"))


@query(_BALANCES)
def loaded_orc(spark, sf_dir):
    return _typed(_through_a_file(spark, _balances(spark, sf_dir), "orc"))


_VALUES = "SELECT count(*) AS n, sum(o_totalprice) AS total, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS share FROM orders"


@query(
    f"WITH v AS ({_VALUES}) SELECT 'percentage' AS kind, format('{{:.2f}}%', share * 100) AS text FROM v UNION ALL SELECT 'number', format('{{:,.2f}}', round(total, 2)) FROM v UNION ALL SELECT 'currency', '$' || format('{{:,.2f}}', round(total, 2)) FROM v "
    "UNION ALL SELECT 'large_number', CASE WHEN total >= 1e12 THEN format('{:.1f}T', total / 1e12) WHEN total >= 1e9 THEN format('{:.1f}B', total / 1e9) WHEN total >= 1e6 THEN format('{:.1f}M', total / 1e6) ELSE format('{:.1f}K', total / 1e3) END FROM v "
    "UNION ALL SELECT 'file_size', CASE WHEN n < 1024 THEN format('{:.2f} B', n::DOUBLE) WHEN n < 1048576 THEN format('{:.2f} KB', n / 1024.0) ELSE format('{:.2f} MB', n / 1048576.0) END FROM v "
    "UNION ALL SELECT 'duration', '1d 1h' UNION ALL SELECT 'value', format('{:,.2f}', round(total, 2)) FROM v"
)
def formatted_values(spark, sf_dir):
    r = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("share")).first()
    total = round(r.total, 2)
    found = {
        "percentage": formatters.percentage(r.share), "number": formatters.number(total), "currency": formatters.currency(total), "large_number": formatters.large_number(total),
        "file_size": formatters.file_size(r.n), "duration": formatters.duration(90061), "value": formatters.value(total + 0.001),
    }
    return rows(spark, [{"kind": k, "text": v} for k, v in found.items()], "kind string, text string")


@query(
    "SELECT count(*) AS rows, 4::BIGINT AS columns, 3::BIGINT AS numeric_columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM supplier)) AS duplicate_rows, round(avg(s_acctbal), 6) AS mean_balance, round(min(s_acctbal), 2) AS min_balance, "
    "round(corr(s_suppkey, s_acctbal), 6) AS r, 100.0 AS completeness FROM supplier"
)
def facade_results(spark, sf_dir):
    eda = EDA(normality_tests=False)
    out = eda.analyze(table(spark, sf_dir, "supplier"), quick=True)
    r = next(p["r"] for p in out["correlations"]["correlation_matrix"]["pearson"] if (p["feature1"], p["feature2"]) == ("s_suppkey", "s_acctbal"))
    one = out["overview"] | {"mean_balance": out["statistics"]["descriptive"]["s_acctbal"]["mean"], "min_balance": out["statistics"]["descriptive"]["s_acctbal"]["min"], "r": r, "completeness": out["quality"]["quality_score"]["completeness"]}
    return tidy(rows(spark, [one], "rows long, columns long, numeric_columns long, duplicate_rows long, mean_balance double, min_balance double, r double, completeness double"), min_balance=2)


@query("SELECT * FROM (VALUES ('correlation_threshold', '0.5', '0.7'), ('missing_threshold', '0.05', '0.1'), ('outlier_method', 'isolation_forest', 'iqr'), ('n_samples_viz', '50000', '10000')) t(setting, thorough, standard)")
def preset_changes(spark, sf_dir):
    """What a preset changes, after a round trip through a dictionary."""
    thorough, standard = EDAConfig.from_dict(preset("thorough").to_dict(), strict=True).to_dict(), EDAConfig().to_dict()
    return rows(spark, [{"setting": k, "thorough": str(v), "standard": str(standard[k])} for k, v in thorough.items() if v != standard[k]], "setting string, thorough string, standard string")


# Charts ----------------------------------------------------------------------------------------------------

_BIN = "CAST(CASE WHEN hi_{i} = lo_{i} THEN 0 ELSE least(9, floor(({c} - lo_{i}) / ((hi_{i} - lo_{i}) / 10))) END AS BIGINT)"


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature1, '{b}' AS feature2, {_BIN.format(i=0, c=a)} AS bin1, {_BIN.format(i=1, c=b)} AS bin2, count(*) AS n FROM lineitem, (SELECT min({a}) AS lo_0, max({a}) AS hi_0, min({b}) AS lo_1, max({b}) AS hi_1 FROM lineitem) GROUP BY ALL"
        for a, b in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))
    )
)
def scatter_matrix(spark, sf_dir):
    return charts.scatter_matrix(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], 10).select("feature1", "feature2", "bin1", "bin2", "n")


_GRID = "SELECT o_orderstatus AS g, count(*) AS n, stddev_samp(o_totalprice) * pow(count(*), -0.2) AS h FROM orders GROUP BY 1"


@query(
    f"WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), s AS ({_GRID}), f AS (SELECT o_orderstatus AS g, least(511, floor((o_totalprice - lo) / ((hi - lo) / 512))) AS b, count(*) AS c FROM orders, e GROUP BY ALL), x AS (SELECT unnest(range(20)) AS i) "
    "SELECT s.g AS group_value, i AS point, round(sum(c * exp(-0.5 * pow((lo + i * (hi - lo) / 19 - (lo + (b + 0.5) * (hi - lo) / 512)) / h, 2))) / max(n * h * sqrt(2 * pi())) * 1e6, 5) AS density FROM s JOIN f USING (g), x, e GROUP BY s.g, i"
)
def violin_densities(spark, sf_dir):
    found = charts.violins(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus", points=20, bins=512)
    return tidy(found.select("group_value", "point", (F.col("density") * 1e6).alias("density")), 5)


SQL["kernel_density"] = (
    "WITH r AS (SELECT count(c_acctbal) AS n, stddev_samp(c_acctbal) AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), f AS (SELECT least(2047, floor((c_acctbal - lo) / ((hi - lo) / 2048))) AS b, count(*) AS c FROM customer, r GROUP BY 1), x AS (SELECT unnest(range(50)) AS i) "
    "SELECT round(lo + i * ((hi - lo) / 49), 6) AS x, round(sum(c * exp(-0.5 * pow((lo + i * (hi - lo) / 49 - (lo + (b + 0.5) * (hi - lo) / 2048)) / (s * pow(n, -0.2)), 2))) / max(n * s * pow(n, -0.2) * sqrt(2 * pi())), 9) AS density FROM f, x, r GROUP BY i, lo, hi"
)


@query("SELECT CAST(i AS BIGINT) AS point, round(quantile_cont(o_totalprice, (i + 0.5) / 4), 4) AS value FROM orders, (SELECT unnest(range(4)) AS i) GROUP BY i".replace("quantile_cont(o_totalprice, (i + 0.5) / 4)", "CASE i WHEN 0 THEN quantile_cont(o_totalprice, 0.125) WHEN 1 THEN quantile_cont(o_totalprice, 0.375) WHEN 2 THEN quantile_cont(o_totalprice, 0.625) ELSE quantile_cont(o_totalprice, 0.875) END"))
def quantile_plot(spark, sf_dir):
    return tidy(rows(spark, [{"point": i, "value": v} for i, (_, v) in enumerate(charts.qq(table(spark, sf_dir, "orders"), "o_totalprice", 4))], "point long, value double"), 4)


@query(union("SELECT '{c}' AS column_name, round(stddev_samp({c}) / sqrt(count({c})), 8) AS standard_error, avg({c}) BETWEEN avg({c}) - stddev_samp({c}) AND avg({c}) + stddev_samp({c}) AS holds_mean FROM lineitem", MEASURES))
def mean_intervals(spark, sf_dir):
    """Half the interval by Student's quantile is the standard error again."""
    from .functions.special import t_ppf

    described = descriptive.moments(table(spark, sf_dir, "lineitem"), MEASURES).select("column_name", "count", "mean", "std").collect()
    n = {r["column_name"]: r["count"] for r in described}
    means = {r["column_name"]: r["mean"] for r in described}
    found = descriptive.mean_interval(spark.createDataFrame(described))
    return tidy(
        rows(spark, [{"column_name": r["column_name"], "standard_error": (r["upper"] - r["lower"]) / 2 / t_ppf(0.975, n[r["column_name"]] - 1), "holds_mean": r["lower"] <= means[r["column_name"]] <= r["upper"]} for r in found], "column_name string, standard_error double, holds_mean boolean"), 8
    )
