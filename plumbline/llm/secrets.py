"""Secrets: fixed patterns, and tokens that a battery of randomness tests cannot tell from random keys.

Candidate tokens are long runs of key characters outside the patterns' spans. Each is read in the narrowest encoding
that holds it (hexadecimal, base32, lower- or upper-case alphanumeric, base64, URL-safe base64). Three tests of the
hypothesis "uniform random symbols" are taken: chi-squared uniformity over the alphabet, the number of runs above and
below its middle, and the correlation of neighbours. The least of the three p-values, times three, is the token's.
Words fail it, keys don't. Which tokens are dismissed as words is decided within classes of similar length by the
Benjamini-Hochberg rule over all documents. What the rule controls are lost keys: of the tokens dismissed, at most the
share fdr are random keys in expectation. It bounds no share of words among the reported tokens; a word that no test
tells from a random key is reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import spans as S
from .common import bind, materialize

# Fixed patterns of the contract, in its order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

LEAST_TOKEN = 20
# '=' may stand before a token (name=value); it belongs to one as trailing padding only.
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}={{0,2}}(?![A-Za-z0-9+/_=-])"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Name, what a token of the encoding looks like, its alphabet in order. The first that fits is taken.
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("alnum", "^(?:[0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", "", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Length classes: tokens shorter than each bound.
LENGTH_CLASSES = (24, 32, 48, 64, 128)
#: p-values are rounded up to a grid of this many steps a power of ten, down to 10**-GRID_POWERS.
GRID, GRID_POWERS = 100, 12


def base_spans(text: Column) -> Column:
    """The contract's spans of a non-null text."""
    assign = F.filter(S.matches(text, "assign", 0, ASSIGN, group=2), lambda s: F.length(s["group"]) >= 6)
    return F.concat(assign, S.matches(text, "access", 1, ACCESS), S.matches(text, "hex", 2, HEX))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by a rational approximation of erfc that keeps its exponential tail."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def p_value(token: Column) -> Column:
    """Combined p-value of "uniform random symbols" of a token without padding."""
    body = F.rtrim(token, F.lit("="))
    alphabet, fold = F.lit(ENCODINGS[-1][2]), body
    for name, pattern, letters in reversed(ENCODINGS[:-1]):
        fits = body.rlike(pattern)
        alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)
        fold = F.when(fits, F.lower(body) if name in ("hex", "alnum") else body).otherwise(fold)

    def tests(t: Column) -> Column:
        x, size = t["x"], F.length(t["alphabet"])
        n = F.size(x).cast("double")
        squares = F.aggregate(F.sequence(F.lit(1), size), F.lit(0.0), lambda a, k: a + F.pow(n - F.size(F.array_remove(x, k)), F.lit(2)))
        # Few symbols fall on many letters: the statistic is taken for a multiple of a chi-squared number with its exact
        # mean and variance, whose cube root is close to normal.
        share = (n - 1) / n
        freedom = (size - 1) / share
        chi = (F.cbrt(F.greatest(size * squares / n - n, F.lit(0.0)) / (share * freedom)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
        high = F.size(F.filter(x, lambda v: v * 2 > size)).cast("double")
        low = n - high
        last = F.size(x) - 1
        steps = F.sequence(F.lit(1), last)
        runs = F.aggregate(steps, F.lit(1), lambda a, i: a + F.when((F.get(x, i) * 2 > size) != (F.get(x, i - 1) * 2 > size), 1).otherwise(0))
        expected = 1 + 2 * high * low / n
        spread = (expected - 1) * (expected - 2) / (n - 1)
        runs_z = F.when(spread > 0, F.abs(runs - expected) / F.sqrt(spread)).otherwise(F.lit(99.0))
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
        power = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.pow(v - mean, F.lit(2)))
        both = F.aggregate(steps, F.lit(0.0), lambda a, i: a + (F.get(x, i) - mean) * (F.get(x, i - 1) - mean))
        serial_z = F.when(power > 0, F.abs(both / power + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        least = F.least(_upper_tail(chi), 2 * _upper_tail(runs_z), 2 * _upper_tail(serial_z))
        return F.least(F.lit(1.0), 3 * least)

    # An alphabet's letters are found by position; each token is read once.
    return bind(
        F.struct(fold.alias("fold"), alphabet.alias("alphabet")),
        lambda t: bind(F.struct(F.transform(F.split(t["fold"], ""), lambda c: F.instr(t["alphabet"], c)).alias("x"), t["alphabet"].alias("alphabet")), tests),
    )


def candidates(text: Column, base: Column) -> Column:
    """Tokens outside the base spans that mix digits and letters, or cases within, with their p-values."""
    long = S.matches(text, "random", 3, TOKEN)
    mixed = F.filter(long, lambda s: (s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]")) | (s["text"].rlike("[a-z][A-Z]") & s["text"].rlike("[A-Z][a-z]")))
    free = S.outside(mixed, base)
    return F.transform(free, lambda s: s.withField("p", p_value(s["text"])).withField("size", F.length(s["text"])))


def length_class(size: Column) -> Column:
    found = F.lit(len(LENGTH_CLASSES))
    for i, bound in reversed(list(enumerate(LENGTH_CLASSES))):
        found = F.when(size < bound, F.lit(i)).otherwise(found)
    return found


def _grid(p: Column) -> Column:
    """Steps of the rounded-up p-value: p <= 10 ** (-steps / GRID)."""
    return F.floor(F.least(F.lit(float(GRID_POWERS)), -F.log10(F.greatest(p, F.lit(1e-300)))) * GRID).cast("int")


def dismissal_steps(found: DataFrame, fdr: float) -> dict[int, int]:
    """Per length class the least grid step at which tokens are dismissed (at most one row a class comes back).

    p-values are counted on the grid before the shuffle, so what is ranked is bounded by classes and steps.
    """
    tokens = found.select(F.explode("_tokens").alias("t")).select(length_class(F.col("t.size")).alias("class"), _grid(F.col("t.p")).alias("step"))
    counts = tokens.groupBy("class", "step").agg(F.count(F.lit(1)).alias("n"))
    rank = F.sum("n").over(Window.partitionBy("class").orderBy(F.desc("step")))
    total = F.sum("n").over(Window.partitionBy("class"))
    passed = counts.withColumns({"rank": rank, "total": total}).where(F.pow(F.lit(10.0), -F.col("step") / GRID) <= fdr * F.col("rank") / F.col("total"))
    return {r["class"]: r["step"] for r in passed.groupBy("class").agg(F.min("step").alias("step")).collect()}


def _searched(rows: DataFrame, text: str) -> DataFrame:
    """rows with _base spans and candidate _tokens of a text column; null text is empty."""
    own = rows.withColumn("_searched", F.coalesce(F.col(text), F.lit(""))).withColumn("_base", base_spans(F.col("_searched")))
    return own.withColumn("_tokens", candidates(F.col("_searched"), F.col("_base"))).drop("_searched")


def _all_spans(steps: dict[int, int]) -> Column:
    kept = F.filter("_tokens", lambda s: _grid(s["p"]) < _limit(s["size"], steps))
    return F.concat("_base", F.transform(kept, lambda s: F.struct(*[s[n].alias(n) for n in ("kind", "rank", "start", "end", "text", "group")])))


def find_secrets(docs: DataFrame, *, fdr: float = 0.05, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base (the patterns' spans) and spans (base and random tokens).

    A span has kind, rank, start, end (code points, end exclusive), text and group. Null text counts as empty; repeated
    rows are searched each; an empty table gives no row; other columns are ignored. Texts are searched once; their
    spans, not the texts, are written for the second look.
    """
    rows = docs.select(docs[id_column].alias("_id"), docs[text_column].alias("_text"))
    found = materialize(_searched(rows, "_text").select("_id", "_base", "_tokens"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_base").alias("base"), _all_spans(dismissal_steps(found, fdr)).alias("spans"))


def _limit(size: Column, steps: dict[int, int]) -> Column:
    cls, limit = length_class(size), F.lit(GRID * GRID_POWERS + 1)
    for number, step in steps.items():
        limit = F.when(cls == number, F.lit(step)).otherwise(limit)
    return limit


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", *[S.count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"), S.joined(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, *, fdr: float = 0.05, text_column: str = "text") -> DataFrame:
    """docs, same columns, with every secret's span replaced by [SECRET:kind]; null texts stay null.

    Texts are searched twice, for the limits of the random tokens and to replace them: less than to write and join them.
    """
    # Columns go by their place meanwhile, so that none of theirs clashes with ours.
    placed = [f"c{i}" for i in range(len(docs.columns))]
    text = placed[docs.columns.index(text_column)]
    rows = docs.toDF(*placed)
    steps = dismissal_steps(_searched(rows.select(text), text), fdr)
    found = _searched(rows, text).withColumn("_spans", _all_spans(steps))
    return found.select(*[(S.replaced(F.col(c), F.col("_spans"), "SECRET") if c == text else F.col(c)).alias(name) for c, name in zip(placed, docs.columns, strict=True)])
