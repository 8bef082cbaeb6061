"""Nearest points by blocks equal all pairs and visit few blocks; strata are broadcast, however many rows they have."""

import numpy as np
import pytest

from plumbline.operators import anomaly, features


@pytest.mark.parametrize("sides, n, k", [(2, 3000, 4), (1, 2000, 30), (5, 1500, 7), (2, 3, 5)])
def test_nearest_points_equal_all_pairs(sides, n, k):
    x, ids = np.round(np.random.default_rng(0).normal(0, 1, (n, sides)), 1 if sides < 5 else 0), np.arange(n)  # many equal points and distances
    d = np.sqrt(sum((x[:, [f]] - x[:, f]) ** 2 for f in range(sides)))
    expected = np.array([np.lexsort((ids, r)) for r in d])[:, :k]
    points, kept = anomaly._first_copies(x, ids, k)
    distances, which = anomaly._search(x, points, kept, anomaly._blocks(points, 256), k)
    assert (which[:, : min(k, n)] == expected).all() and (distances[:, : min(k, n)] == np.take_along_axis(d, expected, 1)).all()
    assert np.isinf(distances[:, n:]).all()


def test_few_blocks_are_visited():
    class Counted(list):
        visits = 0

        def __getitem__(self, at):
            Counted.visits += 1
            return super().__getitem__(at)

    x = np.random.default_rng(1).uniform(0, 1, (100_000, 2))
    blocks = Counted(anomaly._blocks(x, anomaly.BLOCK_POINTS))
    own = x[anomaly._blocks(x, anomaly.TASK_ROWS)[0]]
    anomaly._search(own, x, np.arange(len(x)), blocks, 5)
    assert len(blocks) > 390 and Counted.visits / 2 < 15 * (2 * len(own) / anomaly.GROUP_ROWS)  # two looks a visit


def test_lookup_of_equal_rows(spark):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3.0] * 6 + [4.0, 9.0])], "id long, x0 double")
    own = anomaly._neighbour_join(rows, ["id"], ["x0"], 2).select("id", "neighbours").collect()
    found = {r.id: [(n.d, n.id) for n in r.neighbours] for r in own}
    assert found[0] == [(0, 1), (0, 2)] and found[1] == [(0, 0), (0, 2)] and found[5] == [(0, 0), (0, 1)]
    assert found[6] == [(1, 0), (1, 1)] and found[7] == [(5, 6), (6, 0)]


@pytest.fixture
def strata(spark):
    """Two large strata, one of which has a single key, a middle one and many small ones."""
    parts = ["SELECT id, 'large' AS g FROM range(30000)", "SELECT 7L, 'one key' FROM range(20000)", "SELECT id, 'middle' FROM range(900)", "SELECT id, concat('s', id) FROM range(50)"]
    return spark.sql(" UNION ALL ".join(parts))


@pytest.mark.parametrize("most", [features.MOST_STRATA, 3])
def test_strata_have_their_quotas(strata, monkeypatch, most):
    monkeypatch.setattr(features, "MOST_STRATA", most)
    own = {r.g: r["count"] for r in features.stratified_sample(strata, 500, "g", ["id"]).groupBy("g").count().collect()}
    n = 30000 + 20000 + 900 + 50
    assert own == {"large": 500 * 30000 // n, "one key": 500 * 20000 // n, "middle": 500 * 900 // n} | {f"s{i}": 1 for i in range(50)}


def test_rows_are_not_shuffled_by_stratum(spark, strata):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (strata, strata.where("g <> 'one key'")):
            plan = features.stratified_sample(df, 500, "g", ["id"])._jdf.queryExecution().executedPlan().toString()
            own = plan.split("== Initial Plan ==")[0]
            assert "BroadcastHashJoin" in own
            if df is not strata:
                assert "SortMergeJoin" not in own and "ShuffledHashJoin" not in own
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
