"""Benchmark decontamination by winnowing.

Words of documents and items are lower-cased runs of letters and digits. Of every window of consecutive k-grams the
least hash is a fingerprint, so any shared span of at least window + k - 1 words (the contract's 13) shares one. Document
fingerprints are joined with item fingerprints. A hit is extended to the windows around it, which are compared with the
items' windows word by word; those that are equal are the matched words.
Items shorter than the guarantee are one window each: their length is the k of a family of its own, with a window of
one, so they are found without fail too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, materialize, require, small

WINDOW_WORDS = 13
#: Words of a k-gram; a window of WINDOW_WORDS - K + 1 k-grams spans WINDOW_WORDS words.
K = 8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    whole = F.coalesce(text, F.lit(""))
    # Only A to Z are lowered; lower() does just that on plain ASCII texts, faster.
    low = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.filter(F.split(low, SEPARATORS, -1), lambda w: w != "")


def fingerprints(tokens: Column, k: int, window: int) -> Column:
    """array<struct<h, at>>: winnowed k-gram hashes with the position of their first word; at the left of equal ones."""
    n = F.size(tokens)
    grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(F.xxhash64(F.lit(k), *[F.get(tokens, i + j) for j in range(k)]).alias("h"), i.alias("at")))
    if window == 1:
        return F.when(n >= k, grams).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))

    def least(g: Column) -> Column:
        chosen = F.transform(F.sequence(F.lit(1), F.size(g) - window + 1), lambda i: F.array_min(F.slice(g, i, window)))
        return bind(chosen, lambda c: F.filter(c, lambda x, i: (i == 0) | (F.get(c, i - 1)["at"] != x["at"])))

    return F.when(n >= k + window - 1, bind(grams, least)).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))


def item_table(benchmark: DataFrame, *, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, item_words): items with words and an id."""
    own = benchmark.select(benchmark[id_column].alias("item_id"), words(benchmark[text_column]).alias("item_words"))
    return materialize(own.where(F.col("item_id").isNotNull() & (F.size("item_words") > 0)).distinct())


def item_windows(items: DataFrame) -> DataFrame:
    """(g, item_id): the words of every window of an item, space-joined (words hold no space), each once."""
    n = F.least(F.lit(WINDOW_WORDS), F.size("item_words"))
    starts = F.sequence(F.lit(1), F.size("item_words") - n + 1)
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("item_words", i, n), " "))).alias("g")).distinct()


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, version, n, at): document k-grams that are a fingerprint of some item, n being the words of the windows around.

    docs has doc_id, version and words. The index holds each hash once, so a text that repeats itself joins each of its
    marks with one row, however often an item repeats itself too.
    """
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    short = [r[0] for r in items.where(F.size("item_words") < WINDOW_WORDS).select(F.size("item_words")).distinct().collect()]  # at most 12 lengths
    families = [(WINDOW_WORDS, K, WINDOW_WORDS - K + 1)] + [(n, n, 1) for n in sorted(short)]

    def with_size(n: int):
        return lambda x: x.withField("n", F.lit(n))

    def posted(df: DataFrame, tokens: str, exact: bool) -> DataFrame:
        found = []
        for n, k, window in families:
            own = fingerprints(F.col(tokens), k, window)
            if exact:  # an item belongs to one family
                own = F.when(F.size(tokens) >= n if window > 1 else F.size(tokens) == n, own).otherwise(none)
            found.append(F.transform(own, with_size(n)))
        marks = F.concat(*found) if len(found) > 1 else found[0]
        carried = [c for c in ("doc_id", "version") if c in df.columns]
        return df.select(*carried, F.explode(marks).alias("f")).select(*carried, "f.h", "f.n", "f.at")

    index = small(materialize(posted(items, "item_words", True).select("h", "n").distinct()))
    return posted(docs, "words", False).join(index, ["h", "n"]).select("doc_id", "version", "n", "at").distinct()


def extended(docs: DataFrame, found: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, version, n_words, n, start, g): the document's windows around its hits that are windows of an item, word by word.

    A hit is a k-gram; every window that holds it starts at most n - k words before it. docs has doc_id, version and
    words of the documents with a hit. Work and rows are linear in the hits.
    """
    around = F.flatten(F.transform("ats", lambda at: F.sequence(at - F.when(F.col("n") == WINDOW_WORDS, WINDOW_WORDS - K).otherwise(0), at)))
    per_text = found.groupBy("doc_id", "version", "n").agg(F.collect_set("at").alias("ats"))
    starts = F.filter(F.array_distinct(around), lambda s: (s >= 0) & (s + F.col("n") <= F.size("words")))
    placed = docs.join(per_text, ["doc_id", "version"]).select(
        "doc_id", "version", F.size("words").cast("long").alias("n_words"), "n", F.explode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice("words", s + 1, F.col("n")), " ").alias("g")))).alias("w")
    )
    return placed.select("doc_id", "version", "n_words", "n", "w.start", "w.g").join(small(windows.select("g").distinct()), "g", "left_semi")


def matches(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A written table of the texts with hit words: doc_id, version (a hash of the text), n_words, n_hit, items (sorted ids as strings), whole_window.

    whole_window: a hit of WINDOW_WORDS words, not just of an item shorter than that. Rows that repeat an id are judged by
    their own texts, equal rows once.
    """
    items = item_table(benchmark)
    named = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).where(F.col("doc_id").isNotNull())
    tokenise = lambda df: df.select("doc_id", F.xxhash64("text").alias("version"), words(F.col("text")).alias("words"))
    found = materialize(hits(tokenise(named), items))
    wanted = small(found.select("doc_id").distinct())
    # Only documents with a hit are cut into words again.
    again = tokenise(named.join(wanted, "doc_id", "left_semi").distinct())
    windows = materialize(item_windows(items))
    matched = materialize(extended(again, found, windows))
    items_of = matched.select("doc_id", "version", "g").distinct().join(small(windows), "g")
    items_of = items_of.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    # Ranges in order of their start: each adds the words beyond the furthest end before it.
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))

    def cover(a: Column, r: Column) -> Column:
        end = r["start"] + r["n"]
        return F.struct((a["n"] + F.greatest(end - F.greatest(r["start"], a["reach"]), F.lit(0))).alias("n"), F.greatest(a["reach"], end).alias("reach"))

    ranges = F.array_sort(F.collect_list(F.struct("start", "n")))
    covered = matched.groupBy("doc_id", "version").agg(ranges.alias("ranges"), F.max("n").alias("widest"), F.max("n_words").alias("n_words"))
    covered = covered.select(
        "doc_id", "version", "n_words", F.aggregate("ranges", state, cover, lambda a: a["n"]).cast("long").alias("n_hit"), (F.col("widest") == WINDOW_WORDS).alias("whole_window")
    )
    return materialize(covered.join(items_of, ["doc_id", "version"]))


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items (sorted ids as strings), whole_window, contaminated.

    contaminated: hit words, and at least a twentieth of the words. Null and wordless texts and items have no words and
    hit nothing; rows with a null id are not searched; empty tables give no row or no hits; texts that repeat themselves
    cost no more than others; other columns are ignored.
    """
    hit = matches(docs, benchmark, id_column=id_column, text_column=text_column)
    hit = small(hit.select(F.col("doc_id").alias("hit_id"), F.col("version").alias("hit_version"), "n_hit", "items", "whole_window"))
    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    counted = rows.select("doc_id", F.xxhash64("text").alias("version"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(hit, (F.col("doc_id") == F.col("hit_id")) & (F.col("version") == F.col("hit_version")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("whole_window", F.lit(False)).alias("whole_window"), _contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the texts that hold a passage of the benchmark.

    A whole window of an item removes a text, however long the text is. Items of fewer words may be everyday phrases:
    they remove a text only if their words are a twentieth of it. Rows with a null id stay.
    """
    found = matches(docs, benchmark, id_column=id_column, text_column=text_column)
    found = found.where(F.col("whole_window") | _contaminated(F.col("n_hit"), F.col("n_words")))
    bad = small(found.select(F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_version")))
    return docs.join(bad, (docs[id_column] == bad["bad_id"]) & (F.xxhash64(docs[text_column]) == bad["bad_version"]), "left_anti")
