"""Quantiles of columns: exact at any size by counting in ever finer bins, or by a sketch."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number

#: Bins that one pass counts at most, in all and in one interval; rows that are fetched value by value at most.
MOST_BINS, INTERVAL_BINS, FEW_ROWS = 1 << 16, 1 << 12, 1 << 15


def sketch(c: Column, probabilities: tuple[float, ...]) -> Column:
    return F.percentile_approx(c, F.array(*[F.lit(p) for p in probabilities]), 10_000)


def value_cells(values: dict[int, Column]) -> Column:
    """A row per value and column (c, v), without negative zero; to be filtered by v is not null."""
    return F.inline(F.array(*[F.struct(F.lit(i).alias("c"), (v + F.lit(0.0)).alias("v")) for i, v in values.items()]))


@dataclass(frozen=True)
class _Interval:
    """The n values of column c from low to high (both occur); ranks lists (place among them, place in the column)."""

    c: int
    low: float
    high: float
    n: int
    ranks: tuple[tuple[int, int], ...]


def _settle(interval: _Interval, found: dict) -> list[_Interval]:
    """The interval with the ranks that its ends don't answer, if there are any."""
    left = []
    for place, rank in interval.ranks:
        if interval.low == interval.high or place == 0:
            found[interval.c, rank] = interval.low
        elif place == interval.n - 1:
            found[interval.c, rank] = interval.high
        else:
            left.append((place, rank))
    return [replace(interval, ranks=tuple(left))] if left else []


def _within(interval: _Interval, parts: list[tuple[float, float, int]]) -> list[_Interval]:
    """The parts (low, high, n), in order, that hold ranks of the interval."""
    out, before, ranks = [], 0, sorted(interval.ranks)
    for low, high, n in parts:
        own = tuple((place - before, rank) for place, rank in ranks if before <= place < before + n)
        if own:
            out.append(_Interval(interval.c, low, high, n, own))
        before += n
    return out


def _bin(v: Column, interval: _Interval, bins: int, logarithmic: bool) -> Column:
    """The bin of v, which never falls as v grows, so bins are in the order of the values."""
    low, high = interval.low, interval.high
    if logarithmic:
        v = F.signum(v) * F.log1p(F.abs(v))
        low, high = (math.copysign(math.log1p(abs(x)), x) for x in (low, high))
    elif math.isinf(high - low):
        v, low, high = v / 2, low / 2, high / 2
    share = (v - F.lit(low)) / F.lit(high - low)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(share * bins))).cast("int")


def select_ranks(df: DataFrame, values: list[Column], ranks: list) -> tuple[list[int], dict[tuple[int, int], float]]:
    """(sizes, found): the non-null values of each column, and found[i, rank], the value at a place (from 0) in the order of column i.

    ranks[i] gives the places from the size. Each pass counts an interval's values in bins, by value and not by a table of
    distinct ones, and goes on in the bins that hold a place; the last fetches at most FEW_ROWS values. Tasks and driver
    hold MOST_BINS bins, however many values there are; a pass reads the columns that are still open.
    """
    inf, v = float("inf"), F.col("v")
    finite = F.when(F.abs(v) < inf, v)
    facts = df.select(value_cells(dict(enumerate(values)))).where("v is not null").groupBy("c").agg(
        F.count(v).alias("n"), F.count(finite).alias("m"), F.min(finite).alias("low"), F.max(finite).alias("high"), F.count_if(v == -inf).alias("neg"), F.count_if(v == inf).alias("pos")
    )
    sizes: list[int] = [0] * len(values)
    found: dict[tuple[int, int], float] = {}
    open_: list[_Interval] = []
    for r in facts.collect():
        sizes[r.c] = r.n
        own = []
        for rank in set(ranks[r.c](r.n)):
            if r.neg <= rank < r.neg + r.m:
                own.append((rank - r.neg, rank))
            else:  # NaN is above all, as in Spark's order
                found[r.c, rank] = -inf if rank < r.neg else inf if rank < r.neg + r.m + r.pos else float("nan")
        if own:
            open_ += _settle(_Interval(r.c, r.low, r.high, r.m, tuple(own)), found)
    first = True
    while open_:
        last = sum(x.n for x in open_) <= FEW_ROWS
        bins = min(INTERVAL_BINS, max(16, MOST_BINS // len(open_)))
        cells = []
        for i in sorted({x.c for x in open_}):
            value, k, b = values[i] + F.lit(0.0), F, F
            for at, x in enumerate(open_):
                if x.c == i:
                    inside = (value >= x.low) & (value <= x.high)
                    spread = first and math.copysign(math.log1p(abs(x.low)), x.low) < math.copysign(math.log1p(abs(x.high)), x.high)
                    k, b = k.when(inside, F.lit(at)), b.when(inside, F.lit(0) if last else _bin(value, x, bins, spread))
            cells.append(F.struct(k.alias("k"), b.alias("b"), value.alias("v")))
        near = df.select(F.inline(F.array(*cells))).where("k is not null")
        if last:
            counted = near.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).select("k", F.col("v").alias("low"), F.col("v").alias("high"), "n")
        else:
            counted = near.groupBy("k", "b").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).drop("b")
        parts: dict[int, list] = {}
        for r in counted.collect():
            parts.setdefault(r.k, []).append((r.low, r.high, r.n))
        open_ = [left for at, x in enumerate(open_) for part in _within(x, sorted(parts[at])) for left in _settle(part, found)]
        first = False
    return sizes, found


def exact_quantiles(df: DataFrame, values: list[Column], probabilities: tuple[float, ...]) -> list[list[float] | None]:
    """Linear interpolation over all non-null values of each column; None for a column without values."""
    places = [lambda n: [f((n - 1) * p) for p in probabilities for f in (math.floor, math.ceil)]] * len(values)
    sizes, found = select_ranks(df, values, places)

    def at(i: int, place: float) -> float:
        low, high, share = found[i, math.floor(place)], found[i, math.ceil(place)], place - math.floor(place)
        return low if share == 0 or low == high else low + (high - low) * share if math.isfinite(high - low) else low * (1 - share) + high * share

    return [[at(i, (n - 1) * p) for p in probabilities] if n else None for i, n in enumerate(sizes)]


def ranged_quantiles(df: DataFrame, columns: list[str], probabilities: tuple[float, ...]) -> DataFrame:
    """(column_name, q): exact interpolated quantiles; null for a column without values."""
    found = exact_quantiles(df, [number(c) for c in columns], probabilities)
    return df.sparkSession.createDataFrame(list(zip(columns, found, strict=True)), "column_name string, q array<double>")


def quantile_row(df: DataFrame, columns: list[str], probabilities: tuple[float, ...], accuracy: str = "exact") -> DataFrame:
    """One row: q0, q1, ... with the quantiles of each column. accuracy is exact or ranged (the same), or approx."""
    if accuracy == "approx":
        return df.agg(*[sketch(number(c), probabilities).alias(f"q{i}") for i, c in enumerate(columns)])
    schema = ", ".join(f"q{i} array<double>" for i in range(len(columns)))
    return df.sparkSession.createDataFrame([tuple(exact_quantiles(df, [number(c) for c in columns], probabilities))], schema)
