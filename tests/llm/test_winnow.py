import hashlib
import random
import re

from plumbline.llm import winnow


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(text, items):
    w = tokens(text)
    hit, found = set(), []
    for item_id, it in items:
        v = tokens(it)
        n = min(13, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        at = [i for i in range(len(w) - n + 1) if grams and tuple(w[i : i + n]) in grams]
        if at:
            found.append(str(item_id))
            for i in at:
                hit.update(range(i, i + n))
    n_hit = len(hit)
    return (len(w), n_hit, len(set(found)), hashlib.sha256(",".join(sorted(set(found))).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= len(w))


def made():
    rng = random.Random(11)
    vocabulary = ["the", "of", "Alpha", "beta", "É", "straße", "x1", "42", "the"]
    line = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "-"]) for _ in range(n))
    items = [(i, line(rng.choice([1, 2, 5, 12, 13, 14, 20, 40, 60]))) for i in range(30)] + [(100, None), (101, " ,. "), (102, "the " * 30), (None, "lost item"), (3, "repeated id of another text here")]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 6)):
            item = rng.choice(items)[1] or ""
            words = item.split()
            a = rng.randint(0, max(0, len(words) - 1))
            parts.append(rng.choice([line(rng.randint(1, 30)), item, " ".join(words[a : a + rng.randint(5, 25)]).upper()]))
        docs.append((i, " ".join(parts)))
    return items, [*docs, (900, None), (901, ""), (902, "the " * 3000), (903, items[8][1])]


def test_equals_brute_force(spark):
    items, docs = made()
    d = spark.createDataFrame([(i, t, "s") for i, t in docs] + [(docs[0][0], docs[0][1], "s")], "doc_id long, text string, bad_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute(t, [x for x in items if x[0] is not None]) for i, t in docs}
    rows = winnow.digest(winnow.contamination(d, b)).collect()
    assert len(rows) == len(docs) + 1
    for r in rows:
        assert tuple(r)[1:] == want[r.doc_id], (r, want[r.doc_id], dict(docs)[r.doc_id][:200])
    kept = {r.doc_id for r in winnow.clean(d, b).collect()}
    assert kept == {i for i, t in docs if not removed(t, items)}


def removed(text, items):
    """Whether clean() takes a text out: a whole window of an item, or words of shorter items that make up a twentieth."""
    items = [x for x in items if x[0] is not None]
    return brute(text, [x for x in items if len(tokens(x[1])) >= winnow.WINDOW_WORDS])[1] > 0 or brute(text, items)[4]


def test_a_passage_in_a_long_text_is_removed_and_a_short_phrase_is_not(spark):
    item, phrase = " ".join(f"w{i}" for i in range(20)), "as you like it"
    b = spark.createDataFrame([(1, item), (2, phrase)], "item_id long, text string")
    filler = " ".join(f"x{i}" for i in range(3000))
    texts = {1: f"{filler} {item} {filler}", 2: f"{filler} {phrase} {filler}", 3: f"{phrase} or not", 4: filler}
    d = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(1, "another text of the same id")], "doc_id long, text string")
    assert sorted((r.doc_id, len(r.text) < 100) for r in winnow.clean(d, b).collect()) == [(1, True), (2, False), (4, False)]


def test_texts_that_repeat_themselves_stay_linear(spark):
    b = spark.createDataFrame([(1, "same " * 4000), (2, "one two three " * 1500)], "item_id long, text string")
    d = spark.createDataFrame([(1, "same " * 4000), (2, "one two three " * 2000), (3, "same " * 12)], "doc_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in winnow.digest(winnow.contamination(d, b)).collect()}
    assert found == {1: (4000, 4000, 1), 2: (6000, 6000, 1), 3: (12, 0, 0)}


def test_empty(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "some words here"), (None, "x")], "doc_id long, text string")
    assert winnow.digest(winnow.contamination(e, b)).collect() == []
    assert {(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in winnow.digest(winnow.contamination(d, b)).collect()} == {(1, 3, 0, False), (None, 1, 0, False)}
