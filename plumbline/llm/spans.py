"""Positions of regular-expression matches as columns, in code points, without Python.

Spark returns the matches of a pattern and the pieces between them; a match starts where the lengths of all pieces and
matches before it end. The running sums are taken in blocks of the square root of the number of matches, so documents
with very many matches stay far from quadratic work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import bind

SPAN = "array<struct<kind:string,rank:int,start:int,end:int,text:string,group:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def matches(text: Column, kind: str, rank: int, pattern: str, group: int = 0, only_if: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of the pattern in a non-null text, each with the text of one group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")
    pieces = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("rest"), groups.alias("groups"))

    def positions(x: Column) -> Column:
        n = F.size(x["found"])
        steps = F.transform(x["found"], lambda m, i: F.length(m) + F.length(F.get(x["rest"], i)))
        width = F.ceil(F.sqrt(n)).cast("int")

        def placed(s: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / s["width"]).cast("int")), lambda b: _sum(F.slice(s["steps"], b * s["width"] + 1, s["width"])))

            def rows(total: Column) -> Column:
                def row(m: Column, i: Column) -> Column:
                    block = F.floor(i / s["width"]).cast("int")
                    before = _sum(F.slice(total, F.lit(1), block)) + _sum(F.slice(s["steps"], block * s["width"] + 1, i - block * s["width"]))
                    start = before + F.length(F.get(x["rest"], i))
                    return F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"), (F.get(x["groups"], i) if group else F.lit("")).alias("group"))

                return F.transform(x["found"], row)

            return bind(blocks, rows)

        return bind(F.struct(steps.alias("steps"), width.alias("width")), placed)

    there = text.rlike(pattern) if only_if is None else only_if & text.rlike(pattern)
    return F.when(there, bind(pieces, positions)).otherwise(no_spans())


def by_start(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    return F.array_sort(spans, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).when(x["rank"] != y["rank"], x["rank"] - y["rank"]).otherwise(x["end"] - y["end"]))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(by_start(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _running_max(values: Column) -> Column:
    """Greatest value up to each place of a non-empty list, in blocks of the square root of its length."""
    most = lambda x: F.aggregate(x, F.lit(-1), lambda a, v: F.greatest(a, v))

    def within(s: Column) -> Column:
        def rows(blocks: Column) -> Column:
            def row(v: Column, i: Column) -> Column:
                block = F.floor(i / s["width"]).cast("int")
                return F.greatest(most(F.slice(blocks, F.lit(1), block)), most(F.slice(s["v"], block * s["width"] + 1, i - block * s["width"] + 1)))

            return F.transform(s["v"], row)

        last = F.floor((F.size(s["v"]) - 1) / s["width"]).cast("int")
        return bind(F.transform(F.sequence(F.lit(0), last), lambda b: most(F.slice(s["v"], b * s["width"] + 1, s["width"]))), rows)

    return bind(values, lambda v: bind(F.struct(v.alias("v"), F.ceil(F.sqrt(F.size(v))).cast("int").alias("width")), within))


def outside(found: Column, base: Column) -> Column:
    """Spans of found that overlap none of base, by start. In order of start, a span is free if what of base starts before
    it ends by its start, and what of base starts after it starts from its end on; both are running extremes."""
    far = 2**31 - 2

    def free(x: Column) -> Column:
        ends = F.transform(x, lambda s: F.when(s["base"], s["span"]["end"]).otherwise(-1))
        # Read from the end, the greatest distance to a far point is the least start.
        starts = F.transform(F.reverse(x), lambda s: F.when(s["base"], far - s["span"]["start"]).otherwise(-1))
        near = F.struct(_running_max(ends).alias("reach"), F.reverse(_running_max(starts)).alias("next"))

        def chosen(n: Column) -> Column:
            ok = lambda s, i: ~s["base"] & (F.get(n["reach"], i) <= s["span"]["start"]) & (far - F.get(n["next"], i) >= s["span"]["end"])
            return F.transform(F.filter(x, ok), lambda s: s["span"])

        return bind(near, chosen)

    def ordered(c: Column) -> Column:
        keyed = lambda spans, of_base: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(not of_base).alias("late"), s.alias("span"), F.lit(of_base).alias("base")))
        return F.sort_array(F.concat(keyed(c["base"], True), keyed(c["found"], False)))

    both = F.struct(found.alias("found"), base.alias("base"))
    return bind(both, lambda c: F.when((F.size(c["found"]) > 0) & (F.size(c["base"]) > 0), bind(ordered(c), free)).otherwise(c["found"]))


def overlap(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span (overlapping ones together) replaced by mark and the kind of the first, e.g. [MARK:kind]."""

    def merged(ordered: Column) -> Column:
        # A span is dropped if an earlier one covers its start; the earlier one reaches as far as the furthest end of its run.
        start = F.struct(F.lit(0).alias("reach"), F.lit("").alias("out"), F.lit(1).alias("at"))

        def step(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["reach"]
            out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"], F.greatest(s["start"] + 1 - acc["at"], F.lit(0))), F.lit(f"[{mark}:"), s["kind"], F.lit("]"))).otherwise(acc["out"])
            reach = F.greatest(acc["reach"], s["end"])
            return F.struct(reach.alias("reach"), out.alias("out"), (reach + 1).alias("at"))

        return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"], F.length(text))))

    return F.when(F.size(spans) > 0, bind(by_start(spans), merged)).otherwise(text)
