import math
import random
import re
from collections import Counter

import pytest

from plumbline.llm import preference, quality

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def brute_distance(counts, shares):
    total = sum(counts)
    if not total:
        return None
    d = 0.0
    for c, q in zip(counts, shares, strict=True):
        p = c / total
        m = (p + q) / 2
        d += sum(v * math.log2(v / m) for v in (p, q) if v > 0) / 2
    return math.sqrt(max(d, 0.0))


def brute_kept(text, lang):
    n, chars, *_, failed = brute_counts(text)
    if failed or lang not in quality.COMMON_WORDS:
        return not failed
    text = text or ""
    classes = [sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text), sum(c in ".,;:!?'\"()-" for c in text), sum(c in r"#$%&*+/<=>@[\]^_`{|}~" for c in text), sum(ord(c) > 127 for c in text)]
    classes.append(max(0, chars - sum(classes)))
    near = lambda counts, kind: min(d for q in quality.language_shares(lang, kind) if (d := brute_distance(counts, q)) is not None)
    if chars >= quality.GUARD_CHARS and near(classes, "chars") > quality.CHARS_BASE + quality.CHARS_SPREAD / math.sqrt(chars):
        return False
    tokens = [w for w in re.split(r"[^\W\d_]+", text.lower())] and re.findall(r"[^\W\d_]+", text.lower())
    listed = quality.COMMON_WORDS[lang].split()
    counts = [tokens.count(w) for w in listed]
    counts.append(len(tokens) - sum(counts))
    return not (len(tokens) >= quality.GUARD_WORDS and near(counts, "words") > quality.WORDS_BASE + quality.WORDS_SPREAD / math.sqrt(len(tokens)))


def test_quality_equals_brute_force(spark, sf):
    rng = random.Random(8)
    made = [None, "", "\n\n", "a", "the of " * 40, "x y z " * 3 + "q", " ".join(rng.choice("abcdefgh") for _ in range(300)), "a\x0bb\x0cc\td", "line one here\nline one here\n \n\nline one here ", "w " * 20000, "é#*$ " * 60, "the of " * 60]
    rows = [(i, t, rng.choice(["en", "de", None, "xx"]), 5) for i, t in enumerate(made)] + [(1000 + r.doc_id, r.text, r.lang, 5) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame([*rows, rows[6]], "doc_id long, text string, lang string, n_words int")
    want = {i: (t, lang) for i, t, lang, _ in rows}
    out = quality.judge(docs).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        text, lang = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(text), repr(text)[:100]
        assert r.kept == brute_kept(text, lang), (r, repr(text)[:100])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.kept}


def test_quality_verdict_on_labels(spark):
    """On rows that the references weren't fitted on: of another table, with ids that were held back."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").where("doc_id % 2 = 1")
    rows = [r for r in quality.judge(docs).join(labels, "doc_id").collect() if not r.base_failed]
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    print(len(good), sum(r.kept for r in good), len(bad), sum(r.kept for r in bad))
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_quality_of_an_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def brute_preference(turns):
    pairs = {}
    for pair, side, turn, role, text in set(turns):
        if pair is not None and side in ("chosen", "rejected"):
            pairs.setdefault(pair, {"chosen": [], "rejected": []})[side].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for pair, sides in pairs.items():
        c, r = ([(x[2], x[3]) for x in sorted(set(sides[s]))] for s in ("chosen", "rejected"))
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        render = lambda ts: "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in ts)

        def mask(ts):
            at, found = 0, []
            for role, text in ts:
                start = at + len(f"<|{role}|>\n")
                at = start + len(text) + len("<|end|>\n")
                if role == "assistant":
                    found.append(f"{start}:{at}")
            return ",".join(found)

        out[pair] = (len(c), len(r), n, render(c[:n]), render(c[n:]), render(r[n:]), mask(c[n:]), mask(r[n:]))
    return out


def test_preferences_equal_brute_force(spark):
    rng = random.Random(6)
    turns = []
    for pair in range(80):
        common = [(rng.choice(["user", "assistant", "system"]), rng.choice(["hi", "", "é😀", "go on"])) for _ in range(rng.randint(0, 4))]
        for side in ("chosen", "rejected"):
            own = common + [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "maybe", None])) for _ in range(rng.randint(0, 3))]
            turns += [(pair, side, i, role, text) for i, (role, text) in enumerate(own)]
    turns += [(100, "chosen", 0, "user", "x"), (101, "rejected", 0, None, None), (None, "chosen", 0, "user", "x"), (102, None, 0, "user", "x"), (103, "chosen", None, "user", "n"), (103, "chosen", 0, "user", "n"), *turns[:20]]
    turns += [(104, side, i, "user", f"t{i}") for side in ("chosen", "rejected") for i in range(300)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "pair_id long, side string, turn long, role string, text string, prompt int")
    want = brute_preference(turns)
    rows = preference.format_preferences(df).collect()
    assert {r.pair_id for r in rows} == set(want)
    for r in rows:
        assert tuple(r)[1:] == want[r.pair_id], r.pair_id
    assert preference.format_preferences(df.limit(0)).collect() == []


def conversations():
    rng = random.Random(8)
    out = []
    for conv in range(60):
        for turn in range(rng.randint(1, 7)):
            out.append((conv, rng.choice([turn, turn, None]) if conv % 10 == 9 else turn, rng.choice(["user", "assistant", "assistant", "system", None]), rng.choice(["yes", "no é😀", None, "go on"])))
    return [*out, (None, 0, "assistant", "lost"), (200, 0, "user", "alone"), (201, 0, "assistant", "b"), (201, 0, "assistant", "a"), *out[:9]]


def brute_pairs(turns):
    own = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role, text))
    last = {c: max(((t is not None, t or 0, x or "") for t, r, x in ts if r == "assistant"), default=None) for c, ts in own.items()}
    out = []
    for conv, ts in own.items():
        out += [(conv, "chosen", *t) for t in ts]
        cut = last[conv][1] if last[conv] and last[conv][0] else None
        out += [(conv, "rejected", *t) for t in ts if cut is None or t[0] is None or t[0] < cut]
        theirs = last.get(conv ^ 1)
        if theirs:
            place = cut if cut is not None else max((t[0] for t in ts if t[0] is not None), default=-1) + 1
            out.append((conv, "rejected", place, "assistant", theirs[2]))
    return out


def test_pairs_share_what_comes_before_the_reply(spark):
    turns = conversations()
    df = spark.createDataFrame([(*t, 5) for t in turns], "conv_id long, turn long, role string, text string, pair_id int")
    rows = preference.format_preferences(preference.pair_replies(df)).collect()
    want = brute_preference(brute_pairs(turns))
    assert {r.pair_id: tuple(r)[1:] for r in rows} == want
    assert sum(r.n_common > 0 for r in rows) > len(rows) / 2
    assert preference.pair_replies(df.limit(0)).collect() == []


@pytest.mark.parametrize("made_up", [False, True])
def test_preference_sql(spark, sf, made_up, tmp_path):
    import duckdb

    table = spark.read.parquet(f"{sf}/conversations.parquet")
    if made_up:
        spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/c")
        table = spark.read.parquet(f"{tmp_path}/c")
    connection = duckdb.connect()
    connection.sql(f"create view conversations as from '{tmp_path}/c/*.parquet'" if made_up else f"create view conversations as from '{sf}/conversations.parquet'")
    want = sorted(connection.sql(preference.SQL).fetchall())
    got = preference.format_preferences(preference.pair_replies(table)).collect()
    assert sorted(tuple(r) for r in got) == want
    assert sum(r.n_common > 0 for r in got) > len(got) / 2
