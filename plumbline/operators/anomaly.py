"""Multivariate anomalies: small models fitted on bounded samples or k x k moments, rows scored where they lie."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import normalize, number, numeric_columns
from .features import random_sample
from .quantiles import exact_quantiles

#: Rows of a tree of the isolation forest, and of a sample that a model is fitted on.
TREE_ROWS, FIT_ROWS = 256, 20_000


def complete(df: DataFrame, key: list[str], columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """key columns and x0, x1, ... of rows without a missing feature."""
    df = normalize(df)
    columns = columns or [c for c in numeric_columns(df) if c not in key]
    xs = [f"x{i}" for i in range(len(columns))]
    return df.select(*key, *[number(c).alias(x) for c, x in zip(columns, xs, strict=True)]).na.drop(subset=xs), xs


def _flag(scored: DataFrame, contamination: float, accuracy: int = 100_000) -> DataFrame:
    """is_anomaly: scores above the contamination quantile, an approximate one of bounded memory."""
    limit = scored.agg(F.percentile_approx("anomaly_score", F.lit(1 - contamination), accuracy).alias("_limit"))
    return scored.crossJoin(F.broadcast(limit)).withColumn("is_anomaly", F.col("anomaly_score") > F.col("_limit")).drop("_limit")  # one row


def _grow(x: np.ndarray, depth: int, rng: np.random.Generator):
    if depth == 0 or len(x) <= 1 or (x == x[0]).all():
        return float(len(x))
    while True:
        f = int(rng.integers(x.shape[1]))
        low, high = x[:, f].min(), x[:, f].max()
        if low < high:
            break
    cut = float(rng.uniform(low, high))
    left = x[:, f] < cut
    return f, cut, _grow(x[left], depth - 1, rng), _grow(x[~left], depth - 1, rng)


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _depths(tree, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    stack = [(tree, np.arange(len(x)), 0)]
    while stack:
        node, rows, depth = stack.pop()
        if not isinstance(node, tuple):
            out[rows] = depth + _average_path(node)
            continue
        left = x[rows, node[0]] < node[1]
        stack += [(node[2], rows[left], depth + 1), (node[3], rows[~left], depth + 1)]
    return out


def isolation_forest(df: DataFrame, key: list[str], columns: list[str] | None = None, contamination: float = 0.1, trees: int = 100, seed: int = 42) -> DataFrame:
    """key, anomaly_score, is_anomaly. Trees are grown on the driver from at most FIT_ROWS sampled rows; all rows are scored."""
    rows, xs = complete(df, key, columns)
    sample = np.array([tuple(r) for r in random_sample(rows, FIT_ROWS, key, seed).select(*xs).collect()], dtype=float).reshape(-1, len(xs))
    if len(sample) < 2:
        return rows.select(*key, F.lit(0.0).alias("anomaly_score"), F.lit(False).alias("is_anomaly"))
    rng, size = np.random.default_rng(seed), min(TREE_ROWS, len(sample))
    forest = [_grow(sample[rng.choice(len(sample), size, replace=False)], math.ceil(math.log2(size)) if size > 1 else 1, rng) for _ in range(trees)]
    norm = _average_path(size) or 1.0
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in key], "anomaly_score double"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[xs].to_numpy(dtype=float)
            mean = np.mean([_depths(t, x) for t in forest], axis=0)
            yield batch[key].assign(anomaly_score=2.0 ** (-mean / norm))

    return _flag(rows.mapInPandas(score, fields), contamination)


def mahalanobis(df: DataFrame, key: list[str], columns: list[str] | None = None, percentile: float = 97.5) -> DataFrame:
    """key, anomaly_score (distance), is_anomaly: above the percentile. Mean and covariance come from one aggregate."""
    rows, xs = complete(df, key, columns)
    if len(xs) < 2:
        raise ValueError("at least two columns are needed")
    k = len(xs)
    one = rows.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)], *[F.covar_samp(xs[i], xs[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    nothing = rows.select(*key, F.lit(0.0).alias("anomaly_score"), F.lit(False).alias("is_anomaly"))
    if one.m0 is None:
        return nothing
    c = np.array([[one[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    if np.linalg.matrix_rank(c) < k:
        return nothing
    return _flag(_distances(rows, key, xs, np.array([one[f"m{i}"] for i in range(k)]), c, root=True), 1 - percentile / 100)


def _distances(rows: DataFrame, key: list[str], xs: list[str], mean: np.ndarray, covariance: np.ndarray, root: bool) -> DataFrame:
    inverse = np.linalg.inv(covariance)
    form = F.lit(0.0)
    for i, a in enumerate(xs):
        for j, b in enumerate(xs[i:], start=i):
            form = form + F.lit(float(inverse[i, j] * (1 if i == j else 2))) * (F.col(a) - float(mean[i])) * (F.col(b) - float(mean[j]))
    form = F.greatest(form, F.lit(0.0))
    return rows.select(*key, (F.sqrt(form) if root else form).alias("anomaly_score"))


def elliptic_envelope(df: DataFrame, key: list[str], columns: list[str] | None = None, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Squared robust distances: concentration steps on a bounded sample find the tightest half, all rows are scored."""
    rows, xs = complete(df, key, columns)
    x = np.array([tuple(r) for r in random_sample(rows, FIT_ROWS, key, seed).select(*xs).collect()], dtype=float).reshape(-1, len(xs))
    k, rng, best = len(xs), np.random.default_rng(seed), None
    half = (len(x) + k + 1) // 2
    if half <= k + 1:
        return rows.select(*key, F.lit(0.0).alias("anomaly_score"), F.lit(False).alias("is_anomaly"))
    for _ in range(30):
        chosen = rng.choice(len(x), k + 1, replace=False)
        for _ in range(10):
            mean, c = x[chosen].mean(0), np.cov(x[chosen].T).reshape(k, k) + 1e-9 * np.eye(k)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(c), x - mean)
            after = np.argsort(d, kind="stable")[:half]
            if len(after) == len(chosen) and (np.sort(after) == np.sort(chosen)).all():
                break
            chosen = after
        mean, c = x[chosen].mean(0), np.cov(x[chosen].T).reshape(k, k) + 1e-9 * np.eye(k)
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = det, mean, c
    return _flag(_distances(rows, key, xs, best[1], best[2], root=False), contamination)


def _standardised(rows: DataFrame, xs: list[str]) -> DataFrame:
    stats = rows.agg(*[e for x in xs for e in (F.avg(x).alias(f"_m_{x}"), F.nullif(F.stddev_pop(x), F.lit(0.0)).alias(f"_s_{x}"))])
    return rows.crossJoin(F.broadcast(stats)).select(*[c for c in rows.columns if c not in xs], *[F.coalesce((F.col(x) - F.col(f"_m_{x}")) / F.col(f"_s_{x}"), F.lit(0.0)).alias(x) for x in xs])  # one row


#: Rows of a task, points of a block and rows that are compared with blocks together, at most.
TASK_ROWS, BLOCK_POINTS, GROUP_ROWS = 5_000, 256, 64


def _blocks(x: np.ndarray, most: int) -> list[np.ndarray]:
    """The places of x's rows in blocks of at most so many that lie together: the widest side is cut at its median."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out += [rows] if len(rows) else []
            continue
        half = len(rows) // 2
        sides = x[rows].max(0) - x[rows].min(0)
        order = np.argpartition(x[rows, int(np.argmax(sides))], half) if len(sides) else np.arange(len(rows))
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


def _numbered(rows: DataFrame, key: list[str], xs: list[str]) -> tuple[DataFrame, np.ndarray]:
    """The rows with _id from 0 by key, near ones in one task, and their features by _id: 8 bytes a number in the memory of the driver and of each task."""
    table = rows.withColumn("_id", F.row_number().over(Window.orderBy(*key, *xs)) - 1).toPandas().sort_values("_id", ignore_index=True)
    points = table[xs].to_numpy(dtype=float)
    block, found = np.zeros(len(table), dtype=np.int64), _blocks(points, TASK_ROWS)
    for i, places in enumerate(found):
        block[places] = i
    frame = rows.sparkSession.createDataFrame(table.assign(_block=block), rows.schema.add("_id", "long").add("_block", "long"))
    return frame.repartition(max(8, len(found)), "_block").drop("_block"), points


def _first_copies(points: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of points that are equal the first so many by id: with equal distances going by id, no others can be among so many nearest."""
    order = np.lexsort((ids, *points.T))
    points, ids = points[order], ids[order]
    starts = np.ones(len(ids), dtype=bool)
    starts[1:] = (points[1:] != points[:-1]).any(1)
    places = np.arange(len(ids))
    kept = places - np.maximum.accumulate(np.where(starts, places, 0)) < most
    return points[kept], ids[kept]


def _search(x: np.ndarray, points: np.ndarray, ids: np.ndarray, blocks: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k nearest points of each row of x, equal distances by id; infinite where there are fewer.

    Rows in groups that lie together go through the blocks of points from the nearest on, until the gap to the next block
    is more than every row's k-th distance.
    """
    nearest, which = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
    lows, highs = np.array([points[b].min(0) for b in blocks]), np.array([points[b].max(0) for b in blocks])
    for rows in _blocks(x, GROUP_ROWS) if blocks else []:
        own = x[rows]
        gaps = np.sqrt((np.maximum(0, np.maximum(lows - own.max(0), own.min(0) - highs)) ** 2).sum(1))
        best, found = nearest[rows], which[rows]
        for at in np.argsort(gaps):
            if not gaps[at] * (1 - 1e-12) <= best[:, -1].max():  # rounding of distances
                break
            p, pid = points[blocks[at]], ids[blocks[at]]
            d = np.sqrt(sum(((own[:, [f]] - p[:, f]) ** 2 for f in range(p.shape[1])), np.zeros((len(own), len(p)))))
            some = np.flatnonzero((d <= best[:, [-1]]).any(1))
            both, named = np.hstack([best[some], d[some]]), np.hstack([found[some], np.broadcast_to(pid, d[some].shape)])
            order = np.lexsort((named, both), axis=1)[:, :k]
            best[some], found[some] = np.take_along_axis(both, order, 1), np.take_along_axis(named, order, 1)
        nearest[rows], which[rows] = best, found
    return nearest, which


def _nearest(frame: DataFrame, xs: list[str], points: np.ndarray, ids: np.ndarray, k: int) -> DataFrame:
    """(_nid, neighbours): the k nearest other points as (distance, id), equal distances by id.

    Rows that are equal are looked up once: their k + 1 nearest points, of which a row leaves out itself or the last.
    """
    fields = "_nid long, neighbours array<struct<d: double, id: long>>"
    points, ids = _first_copies(points, ids, k + 1)
    blocks = _blocks(points, BLOCK_POINTS)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["_id"].to_numpy()
            x, member = np.unique(batch[xs].to_numpy(dtype=float), axis=0, return_inverse=True) if xs else (np.empty((1, 0)), np.zeros(len(own), dtype=int))
            d, which = _search(x, points, ids, blocks, k + 1)
            d, which = d[member.reshape(-1)], which[member.reshape(-1)]
            self_at = which == own[:, None]
            self_at[~self_at.any(1), -1] = True
            d, which = d[~self_at].reshape(-1, k), which[~self_at].reshape(-1, k)
            yield pd.DataFrame({"_nid": own, "neighbours": [[{"d": v, "id": n} for v, n in zip(*r, strict=True) if math.isfinite(v)] for r in zip(d.tolist(), which.tolist(), strict=True)]})

    return frame.mapInPandas(near, fields)


def _neighbour_join(rows: DataFrame, key: list[str], xs: list[str], k: int) -> DataFrame:
    """(_nid, neighbours, key...): the k nearest other rows of each row, over all rows."""
    frame, points = _numbered(rows, key, xs)
    return _nearest(frame, xs, points, np.arange(len(points)), k).join(frame.select(F.col("_id").alias("_nid"), *key), "_nid")


def local_outlier_factor(df: DataFrame, key: list[str], columns: list[str] | None = None, contamination: float = 0.1, n_neighbors: int = 20) -> DataFrame:
    """key, anomaly_score (factor), is_anomaly: neighbours, reach distances, densities and their ratio in three joins."""
    rows, xs = complete(df, key, columns)
    k = max(1, min(n_neighbors, rows.count() - 1))
    near = _neighbour_join(rows, key, xs, k).persist()
    reach = near.select("_nid", F.element_at("neighbours", -1)["d"].alias("kd"))
    pairs = near.select("_nid", F.explode("neighbours").alias("n")).select("_nid", F.col("n.d").alias("d"), F.col("n.id").alias("other"))
    density = pairs.join(reach.withColumnRenamed("_nid", "other"), "other").groupBy("_nid").agg((1 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("lrd"))
    factor = pairs.join(density.select(F.col("_nid").alias("other"), F.col("lrd").alias("near_lrd")), "other").groupBy("_nid").agg(F.avg("near_lrd").alias("a")).join(density, "_nid")
    return _flag(factor.join(near.select("_nid", *key), "_nid").select(*key, (F.col("a") / F.col("lrd")).alias("anomaly_score")), contamination)


def dbscan(df: DataFrame, key: list[str], columns: list[str] | None = None, eps: float | None = None, min_samples: int = 5) -> DataFrame:
    """key, is_anomaly (noise), anomaly_score (distance to the nearest clustered row) on standardised features.

    eps defaults to the 90th percentile of the distance to the (min_samples - 1)-th other row.
    """
    rows, xs = complete(df, key, columns)
    rows = _standardised(rows, xs)
    # A row is core if its (min_samples - 1)-th other row is within eps, so no more neighbours are needed.
    frame, points = _numbered(rows, key, xs)
    near = _nearest(frame, xs, points, np.arange(len(points)), max(1, min_samples - 1)).persist()
    if eps is None:
        eps = (exact_quantiles(near, [F.get(F.col("neighbours"), F.lit(min_samples - 2))["d"]], (0.9,))[0] or [0.0])[0]
    core = near.where(F.size(F.filter("neighbours", lambda n: n["d"] <= eps)) + 1 >= min_samples).select(F.col("_nid").alias("core_id"))
    ids = np.sort(core.toPandas()["core_id"].to_numpy(dtype=np.int64))  # of the size of points at most
    to_core = _nearest(frame, xs, points[ids], ids, 1).select("_nid", F.get("neighbours", F.lit(0))["d"].alias("d"))
    out = frame.select(F.col("_id").alias("_nid"), *key).join(to_core, "_nid", "left").join(core, F.col("_nid") == F.col("core_id"), "left")
    clustered = F.col("core_id").isNotNull() | F.coalesce(F.col("d") <= eps, F.lit(False))
    return out.select(*key, F.when(clustered, F.lit(0.0)).otherwise(F.coalesce("d", F.lit(float("inf")))).alias("anomaly_score"), (~clustered).alias("is_anomaly"))


METHODS = {"isolation_forest": isolation_forest, "lof": local_outlier_factor, "mahalanobis": mahalanobis, "elliptic_envelope": elliptic_envelope, "dbscan": dbscan}


def ensemble(df: DataFrame, key: list[str], methods: tuple[str, ...] = ("isolation_forest", "lof"), voting: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """key, votes, is_anomaly (votes of at least voting of the methods), anomaly_score (mean of scores by their maximum)."""
    parts = None
    for name in methods:
        part = METHODS[name](df, key, columns)
        top = part.agg(F.nullif(F.max(F.when(F.col("anomaly_score") < float("inf"), F.col("anomaly_score"))), F.lit(0.0)).alias("_top"))
        part = part.crossJoin(F.broadcast(top)).select(*key, F.col("is_anomaly").cast("int").alias("v"), F.coalesce(F.least(F.lit(1.0), F.col("anomaly_score") / F.col("_top")), F.lit(0.0)).alias("s"))  # one row
        parts = part if parts is None else parts.unionByName(part)
    votes = parts.groupBy(*key).agg(F.sum("v").alias("votes"), (F.sum("s") / len(methods)).alias("anomaly_score"))
    return votes.withColumn("is_anomaly", F.col("votes") >= voting * len(methods))
