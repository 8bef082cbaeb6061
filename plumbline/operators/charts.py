"""Chart data: every chart is a small table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import col, normalize, number, numeric_columns
from ..functions.special import normal_ppf
from .correlation import average_ranks, pearson
from .quantiles import exact_quantiles, quantile_row


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal-width bins, the last one closed; empty bins are absent."""
    v = normalize(df).select(number(column).alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("v") - F.col("lo"), width))))
    return v.crossJoin(F.broadcast(ends)).groupBy(place.cast("long").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")  # one row


def auto_bins(n: int, low: float, high: float, q1: float, q3: float) -> int:
    """The larger of Sturges and Freedman-Diaconis."""
    if n < 2 or high <= low:
        return 1
    fd = 2 * (q3 - q1) / n ** (1 / 3)
    return max(math.ceil(math.log2(n) + 1), math.ceil((high - low) / fd) if fd > 0 else 1)


def histograms(df: DataFrame, columns: list[str] | None = None, bins: int | None = None) -> dict[str, DataFrame]:
    out = {}
    for c in columns or numeric_columns(df):
        if bins is None:
            n, q = normalize(df).agg(F.count(number(c))).first()[0], exact_quantiles(normalize(df), [number(c)], (0.0, 0.25, 0.75, 1.0))[0]
            out[c] = histogram(df, c, auto_bins(n, q[0], q[3], q[1], q[2]) if n else 1)
        else:
            out[c] = histogram(df, c, bins)
    return out


def modes_in_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Bins that hold more than both neighbours (empty ones count as 0)."""
    h, w = histogram(df, column, bins), Window.orderBy("bin")
    before = F.when(F.lag("bin").over(w) == F.col("bin") - 1, F.lag("n").over(w)).otherwise(0)
    after = F.when(F.lead("bin").over(w) == F.col("bin") + 1, F.lead("n").over(w)).otherwise(0)
    return h.withColumns({"b": before, "a": after}).where("n > b and n > a").drop("a", "b")


def box(df: DataFrame, columns: list[str] | None = None, accuracy: str = "exact") -> DataFrame:
    """(column_name, q1, median, q3, whisker ends inside 1.5 IQR, outliers)."""
    df = normalize(df)
    columns = columns or numeric_columns(df)
    one = quantile_row(df, columns, (0.25, 0.5, 0.75), accuracy)
    flat = one.select(*[e for i in range(len(columns)) for e in (F.col(f"q{i}"), (2.5 * F.col(f"q{i}")[0] - 1.5 * F.col(f"q{i}")[2]).alias(f"lo{i}"), (2.5 * F.col(f"q{i}")[2] - 1.5 * F.col(f"q{i}")[0]).alias(f"hi{i}"))])
    rows = df.select(*[number(c).alias(f"v{i}") for i, c in enumerate(columns)]).crossJoin(F.broadcast(flat))  # one row
    inside = lambda i: F.when((F.col(f"v{i}") >= F.col(f"lo{i}")) & (F.col(f"v{i}") <= F.col(f"hi{i}")), F.col(f"v{i}"))
    agg = rows.agg(*[e for i in range(len(columns)) for e in (F.first(f"q{i}").alias(f"q{i}"), F.min(inside(i)).alias(f"a{i}"), F.max(inside(i)).alias(f"b{i}"), (F.count(f"v{i}") - F.count(inside(i))).alias(f"o{i}"))])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"q{i}")[0].alias("q1"), F.col(f"q{i}")[1].alias("median"), F.col(f"q{i}")[2].alias("q3"), F.col(f"a{i}").alias("low_whisker"), F.col(f"b{i}").alias("high_whisker"), F.col(f"o{i}").alias("outliers")) for i, c in enumerate(columns)])))


def density(df: DataFrame, column: str, points: int = 100, bins: int = 2048) -> DataFrame:
    """(x, density): a Gaussian kernel of Scott's width over counts in fine bins, so no row meets every grid point."""
    v = normalize(df).select(number(column).alias("v")).where("v is not null")
    r = v.agg(F.count("v").alias("n"), F.stddev_samp("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not r.n or not r.s:
        return v.sparkSession.createDataFrame([], "x double, density double")
    h = r.s * r.n ** -0.2
    fine = histogram(df, column, bins).select(((F.col("low") + F.col("high")) / 2).alias("c"), "n")
    grid = v.sparkSession.range(points).select((F.lit(r.lo) + F.col("id") * ((r.hi - r.lo) / (points - 1))).alias("x"))
    kernel = F.col("n") * F.exp(-0.5 * F.pow((F.col("x") - F.col("c")) / h, F.lit(2)))
    return grid.crossJoin(F.broadcast(fine)).groupBy("x").agg((F.sum(kernel) / (r.n * h * math.sqrt(2 * math.pi))).alias("density"))  # points x bins


def violins(df: DataFrame, value: str, group: str, points: int = 100, bins: int = 512) -> DataFrame:
    """(group_value, point, x, density): a Gaussian kernel of Scott's width per group, on one grid, over counts in fine bins.

    Only groups with at least two different values have a density. Rows meet no grid point; counts do.
    """
    rows = normalize(df).select(col(group).cast("string").alias("g"), number(value).alias("v")).where("g is not null and v is not null")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    sizes = rows.groupBy("g").agg(F.count("v").alias("n"), (F.stddev_samp("v") * F.pow(F.count("v"), F.lit(-0.2))).alias("h")).where("h > 0")
    width = (F.col("hi") - F.col("lo")) / bins
    fine = rows.crossJoin(F.broadcast(ends)).groupBy("g", "lo", "hi", F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width)).alias("b")).agg(F.count(F.lit(1)).alias("c"))  # one row
    x = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (points - 1)
    centre = F.col("lo") + (F.col("b") + 0.5) * width
    grid = fine.join(sizes, "g").withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    kernel = F.sum(F.col("c") * F.exp(-0.5 * F.pow((x - centre) / F.col("h"), F.lit(2))))
    scale = F.first("n") * F.first("h") * math.sqrt(2 * math.pi)
    return grid.groupBy(F.col("g").alias("group_value"), "point").agg(F.first(x).alias("x"), (kernel / scale).alias("density"))


def scatter_matrix(df: DataFrame, columns: list[str] | None = None, bins: int = 30) -> DataFrame:
    """(feature1, feature2, bin1, bin2, n): counts in a grid for every pair of columns; empty cells are absent.

    One pass finds the ends, one counts all pairs; what is shuffled is bounded by pairs and cells.
    """
    df = normalize(df)
    columns = columns or numeric_columns(df)
    ends = df.agg(*[e for i, c in enumerate(columns) for e in (F.min(number(c)).alias(f"lo{i}"), F.max(number(c)).alias(f"hi{i}"))])
    rows = df.select(*[number(c).alias(f"v{i}") for i, c in enumerate(columns)]).crossJoin(F.broadcast(ends))  # one row

    def place(i: int):
        width = (F.col(f"hi{i}") - F.col(f"lo{i}")) / bins
        return F.when(F.col(f"hi{i}") == F.col(f"lo{i}"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(f"v{i}") - F.col(f"lo{i}"), width)))).cast("long")

    placed = rows.select(*[place(i).alias(f"b{i}") for i in range(len(columns))])
    pairs = [F.struct(F.lit(columns[i]).alias("feature1"), F.lit(columns[j]).alias("feature2"), F.col(f"b{i}").alias("bin1"), F.col(f"b{j}").alias("bin2")) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    cells = placed.select(F.inline(F.array(*pairs))).where("bin1 is not null and bin2 is not null")
    return cells.groupBy("feature1", "feature2", "bin1", "bin2").agg(F.count(F.lit(1)).alias("n"))


def scatter_points(df: DataFrame, columns: list[str], key: list[str], most: int = 5_000, group: str | None = None) -> DataFrame:
    """Sampled rows of two or three columns, and a group, for a scatter plot; the sample is the key's hash's choice."""
    from .features import random_sample

    chosen = normalize(df).select(*[col(k) for k in key], *[number(c).alias(f"axis{i}") for i, c in enumerate(columns)], *([col(group).cast("string").alias("group_value")] if group else []))
    return random_sample(chosen.na.drop(subset=[f"axis{i}" for i in range(len(columns))]), most, key)


def pair_plot(df: DataFrame, columns: list[str], bins: int = 30) -> dict[str, DataFrame]:
    """The tables of a pair plot: histograms on the diagonal, cells of the others, correlations for their titles."""
    return {"diagonal": histograms(df, columns, bins), "cells": scatter_matrix(df, columns, bins), "correlations": pearson(df, columns)}


def dashboard(df: DataFrame, columns: list[str] | None = None, bins: int = 30) -> dict:
    """The tables of an overview page: histograms, boxes and correlations of the numeric columns."""
    columns = columns or numeric_columns(normalize(df))
    return {"histograms": histograms(df, columns, bins), "boxes": box(df, columns), "correlations": correlation_heatmap(df, columns)}


def save_figure(svg: str, path: str) -> str:
    """Writes a figure as .svg, or as a page of its own as .html."""
    from pathlib import Path

    kind = Path(path).suffix
    if kind not in (".svg", ".html"):
        raise ValueError(f"figures are written as .svg or .html, not {kind!r}")
    Path(path).write_text(svg if kind == ".svg" else f"<!DOCTYPE html><meta charset='utf-8'>{svg}", encoding="utf-8")
    return path


def qq(df: DataFrame, column: str, points: int = 200) -> list[tuple[float, float]]:
    """(normal quantile, value) at evenly spread places, by exact percentiles."""
    p = [(i + 0.5) / points for i in range(points)]
    q = exact_quantiles(normalize(df), [number(column)], tuple(p))[0]
    return [] if q is None else [(normal_ppf(x), v) for x, v in zip(p, q, strict=True)]


def correlation_heatmap(df: DataFrame, columns: list[str] | None = None, mask_upper: bool = False, mask_diagonal: bool = False) -> DataFrame:
    """(feature1, feature2, r, masked): the whole matrix with both halves and the diagonal."""
    half = pearson(df, columns).select("feature1", "feature2", "r")
    names = half.select(F.col("feature1").alias("f")).union(half.select("feature2")).distinct()
    upper = half.withColumn("masked", F.lit(mask_upper))
    lower = half.select(F.col("feature2"), F.col("feature1"), "r", F.lit(False))
    return upper.union(lower).union(names.select("f", "f", F.lit(1.0), F.lit(mask_diagonal)))


def bars(df: DataFrame, x: str, y: str | None = None, top: int | None = None) -> DataFrame:
    """(label, value): counts or sums, largest first."""
    rows = df.groupBy(col(x).cast("string").alias("label")).agg((F.sum(number(y)) if y else F.count(F.lit(1)).cast("double")).alias("value")).orderBy(F.desc("value"), "label")
    return rows.limit(top) if top else rows


def ranked(df: DataFrame, column: str) -> DataFrame:
    return average_ranks(normalize(df).select(number(column).alias("v")), "v", [])


def svg_bars(rows: list[tuple[str, float]], title: str, width: int = 480) -> str:
    """A bar chart as text; labels are escaped."""
    from html import escape

    top = max((v for _, v in rows), default=0) or 1
    body = "".join(f'<text x="4" y="{34 + 18 * i}" font-size="11">{escape(str(k))}</text><rect x="150" y="{24 + 18 * i}" width="{max(0.0, v / top) * (width - 230):.1f}" height="12" fill="#4878a8"/><text x="{width - 74}" y="{34 + 18 * i}" font-size="11">{v:.4g}</text>' for i, (k, v) in enumerate(rows))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{30 + 18 * len(rows)}"><text x="4" y="14" font-size="13">{escape(title)}</text>{body}</svg>'
