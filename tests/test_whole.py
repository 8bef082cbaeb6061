"""Registered queries and operators read the whole of their tables: small fixtures that a cap or a filter would change."""

import datetime

import numpy as np
import pandas as pd

from plumbline import catalog
from plumbline.operators import anomaly


def orders(spark, folder, days, per_day=2):
    """orders.parquet with per_day orders on each of the days (numbers from 1994-01-01); value by day."""
    rng, rows, key = np.random.default_rng(5), [], 0
    for d in days:
        for _ in range(per_day):
            key += 1
            rows.append((key, datetime.datetime(1994, 1, 1) + datetime.timedelta(days=int(d)), float(np.round(1000 + d + 50 * np.sin(2 * np.pi * d / 7) + rng.normal(0, 20) + 900 * (d == 333), 2))))
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp, o_totalprice double").repartition(7).write.parquet(f"{folder}/orders.parquet")
    return pd.DataFrame(rows, columns=["key", "day", "price"]).groupby("day")["price"].mean()


def slow_loess(y, span, at, weights):
    """Weighted least squares at each place, over all points, those beyond the window with weight zero."""
    n, out = len(y), []
    q = min(span, n)
    for a in at:
        low = min(max(round(a - q / 2), 0), n - q)
        reach = max(abs(a - low), abs(a - low - q + 1)) * max(1.0, span / n) * 1.001
        w = np.array([weights[i] * max(0.0, 1 - min(1.0, abs(i - a) / reach) ** 3) ** 3 if low <= i < low + q else 0.0 for i in range(n)])
        if (w > 0).sum() < 2:  # no line through one point: its value, or the window's mean
            out.append(y[w > 0].mean() if w.any() else y[low : low + q].mean())
            continue
        root = np.sqrt(w)
        b = np.linalg.lstsq(np.column_stack([root, root * (np.arange(n) - a)]), root * y, rcond=None)[0]
        out.append(b[0])
    return np.array(out)


def slow_remainder(y, period, seasonal=7):
    n, trend, weights = len(y), np.zeros(len(y)), np.ones(len(y))
    span = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1
    for outer in (0, 1):
        for _ in range(2):
            cycle = np.zeros(n + 2 * period)
            for phase in range(period):
                own = (y - trend)[phase::period]
                cycle[phase::period] = slow_loess(own, seasonal, range(-1, len(own) + 1), weights[phase::period])[: len(cycle[phase::period])]
            smooth = cycle
            for k in (period, period, 3):
                smooth = np.array([smooth[i : i + k].mean() for i in range(len(smooth) - k + 1)])
            season = cycle[period : period + n] - slow_loess(smooth, period | 1, range(len(smooth)), np.ones(len(smooth)))[:n]
            trend = slow_loess(y - season, span, range(n), weights)
        rest = y - season - trend
        if outer == 0:
            weights = (1 - np.minimum(1, np.abs(rest) / (6 * np.median(np.abs(rest)))) ** 2) ** 2
    return rest


def test_stl_scores_every_day(spark, tmp_path):
    values = orders(spark, tmp_path, range(450))
    own = catalog.queries()["stl_anomalies"](spark, str(tmp_path)).toPandas().sort_values("t")
    assert own["t"].tolist() == [d.strftime("%Y-%m-%d") for d in values.index]
    rest = slow_remainder(values.to_numpy(), 7)
    score = np.abs(rest) / rest.std()
    np.testing.assert_allclose(own["anomaly_score"], score, atol=1e-6)
    assert own["is_anomaly"].tolist() == (score > 3).tolist() and own["is_anomaly"].iloc[333]


def test_missing_days_reads_every_order(spark, tmp_path):
    orders(spark, tmp_path, [0, 1, 2, 3, 7, 8, 10], per_day=1)  # only one key is a multiple of 4
    own = catalog.queries()["missing_days"](spark, str(tmp_path)).toPandas()
    assert sorted(own["t"]) == ["1994-01-05", "1994-01-06", "1994-01-07", "1994-01-10"]


def test_dbscan_counts_all_neighbours(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, 2000), rng.normal(30, 0.5, 210), [60.0, 61.0]])  # more than 200 rows that are not core lie between
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double")
    z = (x - x.mean()) / x.std()
    d = np.abs(z[:, None] - z[None, :])
    for least in (5, 205, 215):
        eps = np.quantile(np.sort(d, axis=1)[:, least - 1], 0.9)
        core = (d <= eps + 1e-9).sum(1) >= least
        to_core = d[:, core].min(1)
        own = anomaly.dbscan(df, ["id"], min_samples=least).toPandas().sort_values("id")
        assert own["is_anomaly"].tolist() == (to_core > eps + 1e-9).tolist() and own["is_anomaly"].any() and not own["is_anomaly"].all()
        np.testing.assert_allclose(own["anomaly_score"], np.where(to_core > eps + 1e-9, to_core, 0), atol=1e-6)


def test_neighbour_methods_take_more_than_20000_rows(spark):
    df = spark.range(20_100).selectExpr("id", "CAST(IF(id = 77, 50000, id) AS DOUBLE) AS v")
    for method in (anomaly.dbscan, anomaly.local_outlier_factor):
        own = method(df, ["id"]).toPandas().set_index("id")
        assert len(own) == 20_100 and own["is_anomaly"][77] and np.isfinite(own["anomaly_score"]).all()
        assert own["anomaly_score"].idxmax() == 77
