"""Personal data: fixed patterns, and candidates of high-recall generators chosen by boosted trees.

The generators propose overlapping spans of further formats (national phone numbers, social security numbers, IBANs,
masked e-mail addresses, dates of birth). Each candidate has features of its format (length, digits, checksum) and its
context: cue words before it, read past other words with digits, so that the cue of a list counts for all its entries,
and whether personal data of any format stands beside it. The trees of pii_model.json are evaluated as column
expressions; a candidate is redacted if its score reaches its kind's calibrated threshold and no better overlapping
candidate does.
"""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import bind

# Fixed patterns of the contract, in its order; possessive where nothing later could match what is given back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

EXTRA_KINDS = ("phone_local", "ssn", "iban", "email_masked", "birth")
GENERATORS = {
    "phone_local": r"(?<![0-9+(.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "email_masked": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]{1,63}){1,6}",
    "birth": r"(?<![0-9-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-])",
}
#: Code points of the context that are read, and those that cue words are looked for in once words with digits are out.
CONTEXT, BEFORE, NEAR = 160, 32, 16
# Whole words: "part" is not in "department".
CUES = r"(?i)(?<![A-Za-z])(?:(?:tele|cell)?phones?|tel|call(?:s|ed)?|mobile|fax|ssn|social|ibans?|accounts?|(?:e-?)?mails?|contacts?|write to|born|birth(?:day|date)?|dob)(?![A-Za-z])"
NEGATIVE_CUES = r"(?i)(?<![A-Za-z])(?:orders?|invoices?|parts?|versions?|isbn|sku|ref(?:erence)?|serial|builds?|tickets?|models?)(?![A-Za-z])"
#: How a masked address ends: a masked dot, or a top-level domain.
MASKED_END = r"(?i)(?:[(\[]dot[)\]]\x20?[a-z]{2,}|\.\x20?(?:com|org|net|edu|gov|info|[a-z]{2}))$"
#: Words with a digit, and the marks between the entries of a list.
WITH_DIGITS = r"[^\x20\n]*[0-9][^\x20\n]*|(?<=\x20)[,;|/.-]+(?=\x20)|(?<=\x20)(?:or|and|und|et|y)(?=\x20)"
#: Personal data beside a candidate, on either side.
ALIKE_BEFORE = r"(?:[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{10,}|@[A-Za-z0-9.-]+|[0-9]{4}-[0-9]{2}-[0-9]{2})[^0-9A-Za-z]{1,6}(?:(?:or|and)\x20)?$"
ALIKE_AFTER = r"^[^0-9A-Za-z]{1,6}(?:(?:or|and)\x20)?(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{10,}|[A-Za-z0-9._-]+@|[0-9]{4}-[0-9]{2}-[0-9]{2})"
FEATURES = [*EXTRA_KINDS, "length", "digits", "distinct_digits", "separators", "valid", "cue", "negative_cue", "cue_near", "alike_before", "alike_after"]
#: Generators' spans within this distance may overlap: the longest one, and starts that lie 8 code points apart a kind.
NEIGHBOURS = 5 * (553 // 8 + 1)


def mod97(text: str) -> int:
    """Remainder of an IBAN's check: the first four characters go last, letters count from 10."""
    remainder = 0
    for c in text[4:] + text[:4]:
        number = int(c, 36)
        remainder = (remainder * (10 if number < 10 else 100) + number) % 97
    return remainder


@cache
def model() -> dict:
    return json.loads(Path(__file__).with_name("pii_model.json").read_text())


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    numbers = F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int")))
    doubled = F.transform(numbers, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def _at_most_255(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(text: Column) -> Column:
    """The contract's spans of a non-null text."""
    email = S.matches(text, "email", 0, EMAIL, only_if=F.contains(text, F.lit("@")))
    ip = F.filter(S.matches(text, "ip", 1, IP), lambda s: _at_most_255(s["text"]))
    card = F.filter(S.matches(text, "card", 2, CARD), lambda s: F.when(F.length(_digits(s["text"])) <= 19, _luhn(_digits(s["text"]))).otherwise(F.lit(False)))
    phone = F.filter(S.matches(text, "phone", 3, PHONE, only_if=F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["text"])).between(10, 15))
    return F.concat(email, ip, card, phone)


def _iban_ok(text: Column) -> Column:
    plain = F.regexp_replace(text, "[^A-Za-z0-9]", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    letters = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def step(a: Column, c: Column) -> Column:
        number = F.instr(letters, F.upper(c)) - 1
        return (a * F.when(number < 10, 10).otherwise(100) + number) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _valid(kind: Column, text: Column, digits: Column) -> Column:
    area, group, serial = F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4)
    month, day = F.substring(digits, 5, 2).cast("int"), F.substring(digits, 7, 2).cast("int")
    return (
        F.when(kind == "phone_local", (F.length(digits) == 10) & ~F.substring(digits, 1, 1).isin("0", "1") & ~F.substring(digits, 4, 1).isin("0", "1"))
        .when(kind == "ssn", ~area.isin("000", "666") & (F.substring(digits, 1, 1) != "9") & (group != "00") & (serial != "0000"))
        .when(kind == "iban", _iban_ok(text))
        .when(kind == "email_masked", text.rlike(MASKED_END))
        .when(kind == "birth", month.between(1, 12) & day.between(1, 31))
        .otherwise(F.lit(True))
    )


def feature_columns(span: Column, text: Column) -> Column:
    """A struct of FEATURES as doubles."""
    at = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before, after = F.substring(text, at + 1, span["start"] - at), F.substring(text, span["end"] + 1, F.lit(CONTEXT))
    digits = _digits(span["text"])
    plain = F.regexp_replace(F.regexp_replace(before, WITH_DIGITS, ""), r"\x20+", " ")

    def of(c: Column) -> Column:
        values = [span["kind"] == k for k in EXTRA_KINDS]
        values += [F.length(span["text"]), F.length(digits), F.size(F.array_distinct(F.filter(F.split(digits, ""), lambda d: d != ""))), F.length(F.regexp_replace(span["text"], "[A-Za-z0-9]", ""))]
        words = F.right(c["plain"], F.lit(BEFORE))
        values += [_valid(span["kind"], span["text"], digits), words.rlike(CUES), words.rlike(NEGATIVE_CUES), F.right(c["plain"], F.lit(NEAR)).rlike(CUES)]
        values += [c["before"].rlike(ALIKE_BEFORE), c["after"].rlike(ALIKE_AFTER)]
        return F.struct(*[v.cast("double").alias(n) for n, v in zip(FEATURES, values, strict=True)])

    return bind(F.struct(plain.alias("plain"), before.alias("before"), after.alias("after")), of)


def _tree(node, features: Column) -> Column:
    if not isinstance(node, list):
        return F.lit(float(node))
    return F.when(features[FEATURES[node[0]]] <= node[1], _tree(node[2], features)).otherwise(_tree(node[3], features))


def score(features: Column) -> Column:
    total = F.lit(0.0)
    for tree in model()["trees"]:
        total = total + _tree(tree, features)
    return total


def extra_spans(text: Column, base: Column) -> Column:
    """Chosen candidates outside the base spans."""
    found = F.concat(*[S.matches(text, kind, len(KINDS) + i, GENERATORS[kind]) for i, kind in enumerate(EXTRA_KINDS)])

    def reached(s: Column) -> Column:
        limit = F.lit(99.0)
        for kind, value in model()["thresholds"].items():
            limit = F.when(s["kind"] == kind, F.lit(value)).otherwise(limit)
        return s["score"] >= limit

    def better(x: Column, y: Column) -> Column:
        return S.overlap(x, y) & ((y["score"] > x["score"]) | ((y["score"] == x["score"]) & (y["rank"] < x["rank"])))

    def undisputed(ordered: Column) -> Column:
        # In order of start only neighbours can overlap, as a generator's spans are bounded and don't overlap each other.
        nearby = lambda i: F.slice(ordered, F.greatest(i - NEIGHBOURS, F.lit(0)) + 1, F.lit(2 * NEIGHBOURS + 1))
        return F.filter(ordered, lambda x, i: ~F.exists(nearby(i), lambda y: better(x, y)))

    def choose(proposed: Column) -> Column:
        scored = F.transform(S.outside(proposed, base), lambda s: s.withField("score", bind(feature_columns(s, text), score)))
        chosen = bind(S.by_start(F.filter(scored, reached)), undisputed)
        plain = F.transform(chosen, lambda s: F.struct(*[s[n].alias(n) for n in ("kind", "rank", "start", "end", "text", "group")]))
        return F.when(F.size(proposed) > 0, plain).otherwise(S.no_spans())

    return bind(found, choose)


def find_personal_data(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base (the patterns' spans) and spans (base and chosen candidates).

    A span has kind, rank, start, end (code points, end exclusive), text and group. Null text counts as empty; repeated
    rows are searched each; an empty table gives no row; other columns are ignored.
    """
    rows = docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("_text"))
    found = rows.select("doc_id", F.struct("_text", base_spans(F.col("_text")).alias("base")).alias("x"))
    both = found.select("doc_id", bind(F.col("x"), lambda x: F.struct(x["base"].alias("base"), F.concat(x["base"], extra_spans(x["_text"], x["base"])).alias("spans"))).alias("y"))
    return both.select("doc_id", F.col("y.base").alias("base"), F.col("y.spans").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    once = found.select("doc_id", F.struct("base", "spans").alias("f")).select(
        "doc_id", bind(F.col("f"), lambda f: F.struct(*[S.count_kind(f["base"], k).alias(f"n_{k}") for k in KINDS], S.joined(f["base"]).alias("base"), S.joined(f["spans"]).alias("spans"))).alias("d")
    )
    return once.select("doc_id", *[F.col(f"d.n_{k}") for k in KINDS], F.sha2("d.base", 256).alias("base_sha256"), F.col("d.spans").alias("spans"))
