"""Quality rules: word counts, repetition, and distribution divergence from language references.

A document's histogram of character classes and its histogram of its language's commonest words are compared with the
language's reference histograms by the Jensen-Shannon distance. Short histograms scatter, so the allowed distance is a
base plus a term that falls with the square root of what was counted, and a histogram below its minimum length isn't
judged. References are fitted on at most FIT_ROWS labelled rows by python -m plumbline.llm.quality_references.
"""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

FIT_ROWS = 20_000
MIN_WORDS = 50
#: Histograms of fewer characters or words aren't judged.
GUARD_CHARS, GUARD_WORDS = 200, 50
#: Allowed distance: base + spread / sqrt(counted).
CHARS_BASE, CHARS_SPREAD = 0.12, 1.5
WORDS_BASE, WORDS_SPREAD = 0.17, 1.5

CLASSES = ("upper", "digit", "punctuation", "symbol", "beyond_ascii", "lower")
# The commonest words of each language.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as by be this are at from",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que pour est dans qui par sur pas au avec",
    "es": "de la que el en y los se las del un por con no una su para al es lo",
}
SPACE = r"[\x20\x09-\x0D]+"


@cache
def references() -> dict[str, dict[str, list[float]]]:
    """Per language: chars (shares of CLASSES) and words (shares of COMMON_WORDS, then of all other words)."""
    return json.loads(Path(__file__).with_name("quality_references.json").read_text())["languages"]


def _left(text: Column, kept: str) -> Column:
    """Characters of a class: what is left once all others are taken out."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def class_counts(text: Column, in_words: Column) -> Column:
    upper, digit = _left(text, "A-Z"), _left(text, "0-9")
    punctuation, symbol = _left(text, r".,;:!?'\"()\-"), _left(text, r"#$%&*+/<=>@\[\\\]^_`{|}~")
    beyond = F.when(F.octet_length(text) == F.length(text), F.lit(0)).otherwise(F.length(F.regexp_replace(text, r"[\x00-\x7F]+", "")))
    first = F.array(upper, digit, punctuation, symbol, beyond)
    return bind(first, lambda c: F.concat(c, F.array(F.greatest(in_words.cast("int") - F.aggregate(c, F.lit(0), lambda a, v: a + v), F.lit(0)))))


def common_counts(text: Column, lang: Column) -> Column:
    """Occurrences of the language's common words, then of all other words; null for languages without a reference."""
    own = F.lit(None).cast("array<string>")
    for name, listed in COMMON_WORDS.items():
        own = F.when(lang == name, F.array(*[F.lit(w) for w in listed.split()])).otherwise(own)

    def counts(x: Column) -> Column:
        places = F.filter(F.transform(x["tokens"], lambda w: F.array_position(x["own"], w).cast("int")), lambda k: k > 0)

        def each(p: Column) -> Column:
            found = F.transform(F.sequence(F.lit(1), F.size(x["own"])), lambda k: F.size(p) - F.size(F.array_remove(p, k)))
            return F.concat(found, F.array(F.size(F.filter(x["tokens"], lambda w: w != "")) - F.size(p)))

        return bind(places, each)

    tokens = F.split(F.lower(text), r"[^\p{L}]+", -1)
    return F.when(own.isNotNull(), bind(F.struct(own.alias("own"), tokens.alias("tokens")), counts))


def js_distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of a histogram and reference shares; 0 to 1."""

    def of(x: Column) -> Column:
        total = F.aggregate(x["c"], F.lit(0.0), lambda a, v: a + v)
        p = F.transform(x["c"], lambda v: v / total)

        def term(a: Column, b: Column) -> Column:
            middle = (a + b) / 2
            half = lambda v: F.when(v > 0, v * F.log2(v / middle)).otherwise(F.lit(0.0))
            return (half(a) + half(b)) / 2

        divergence = F.aggregate(F.zip_with(p, x["q"], term), F.lit(0.0), lambda a, v: a + v)
        return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0))))

    return bind(F.struct(counts.alias("c"), shares.alias("q")), of)


def language_shares(lang: str, kind: str) -> list[list[float]]:
    """What a document of the language may look like: its reference, and half-and-half mixtures, as many documents switch language.

    Characters may also follow each other language's reference or mix with it, as labels can be wrong; of another
    language's words none is common in this one.
    """
    own = references()[lang][kind]
    foreign = [shares[kind] for name, shares in references().items() if name != lang]
    others = foreign if kind == "chars" else [[0.0] * (len(own) - 1) + [1.0]]
    mixed = [[(a + b) / 2 for a, b in zip(own, other, strict=True)] for other in others]
    return [own, *mixed, *(foreign if kind == "chars" else [])]


def _distance(counts: Column, lang: Column, kind: str) -> Column:
    """Least distance of a histogram to its language's shares; null for a language without a reference."""
    shares = F.lit(None).cast("array<array<double>>")
    for name in references():
        shares = F.when(lang == name, F.array(*[F.array(*[F.lit(float(v)) for v in q]) for q in language_shares(name, kind)])).otherwise(shares)
    # Bound, as an expression that a lambda names is else evaluated for every reference.
    return bind(counts, lambda c: F.array_min(F.transform(shares, lambda q: js_distance(c, q))))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first included.

    Most texts have as many distinct window hashes as windows and are done. In the others windows are ordered by hash
    and place; those with an equal neighbour are the repeated ones. In order of place, each covers three words, or as
    many as there are up to the next one.
    """

    def marked(windows: Column) -> Column:
        near = lambda x, i: F.coalesce(F.get(windows, i)["h"] == x["h"], F.lit(False))
        places = F.array_sort(F.transform(F.filter(windows, lambda x, i: near(x, i - 1) | near(x, i + 1)), lambda x: x["at"]))
        return bind(places, lambda p: F.aggregate(F.transform(p, lambda at, i: F.coalesce(F.least(F.get(p, i + 1) - at, F.lit(3)), F.lit(3))), F.lit(0), lambda a, v: a + v))

    def counted(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(placed, marked))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 4, bind(hashes, counted)).otherwise(F.lit(0))


def measure(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs with counts, the two histograms and their distances.

    Null text has no words; a null or unknown language has no reference, so its distances are null.
    """
    whole = F.coalesce(docs[text_column], F.lit(""))
    rows = docs.select(*[docs[c].alias(f"_c_{c}") for c in carried], docs[id_column].alias("_id"), whole.alias("_text"), docs[lang_column].alias("_lang"))
    rows = rows.withColumn("_words", F.filter(F.split("_text", SPACE, -1), lambda w: w != ""))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    counted = rows.select(
        *[f"_c_{c}" for c in carried], "_id", "_lang", "_text",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _left(F.col("_text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )
    # A word list that is used by several columns is computed once; no column below refers to it in a lambda.
    histograms = counted.withColumns({"class_counts": class_counts(F.col("_text"), F.col("word_chars")), "word_counts": common_counts(F.col("_text"), F.col("_lang"))}).drop("_text")
    counted_words = F.aggregate("word_counts", F.lit(0), lambda a, v: a + v)
    return histograms.withColumns(
        {
            "char_distance": F.when(F.col("word_chars") >= GUARD_CHARS, _distance(F.col("class_counts"), F.col("_lang"), "chars")),
            "word_distance": F.when(counted_words >= GUARD_WORDS, _distance(F.col("word_counts"), F.col("_lang"), "words")),
            "counted_words": counted_words,
        }
    )


def _verdict(measured: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far_chars = F.col("char_distance") > CHARS_BASE + CHARS_SPREAD / F.sqrt("word_chars")
    far_words = F.col("word_distance") > WORDS_BASE + WORDS_SPREAD / F.sqrt("counted_words")
    diverges = F.coalesce(far_chars, F.lit(False)) | F.coalesce(far_words, F.lit(False))
    return measured.withColumns({"base_failed": failed, "kept": ~failed & ~diverges})


def judge(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, kept, both distances.

    kept is false for documents that fail the base rules or lie too far from a reference. Null and empty texts fail;
    repeated rows are judged each; an empty table gives no row; other columns are ignored.
    """
    return _verdict(measure(docs, id_column=id_column, text_column=text_column, lang_column=lang_column)).select(
        F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"
    )


def keep_good(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """docs, same columns, without the rows that are not kept."""
    names = tuple(docs.columns)
    judged = _verdict(measure(docs, id_column=id_column, text_column=text_column, lang_column=lang_column, carried=names))
    # The optimizer would copy the verdict's whole expression into a filter below every projection; it moves no filter
    # below a projection that holds a partition's number, so the verdict is computed once.
    decided = judged.select(*[f"_c_{c}" for c in names], "kept", F.spark_partition_id().alias("_part"))
    return decided.where(F.col("kept") & (F.col("_part") >= 0)).select(*[F.col(f"_c_{c}").alias(c) for c in names])
