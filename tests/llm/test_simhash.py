import random
from itertools import combinations

import numpy as np
import xxhash

from plumbline.llm import simhash
from plumbline.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in fps}


def made():
    rng = random.Random(2)
    base = [" ".join(rng.choice(["aa", "Bb", "cc", "dD", "ee", "é", "ff"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(60, 200))) for _ in range(12)]
    texts = [None, "", " \n", "one", "Two words", "three of them", "just four words here", "\x0b\x0ctab\there"]
    for b in base:
        texts += [b, b.upper() if b.isascii() else b]
        for _ in range(8):
            words = b.split()
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    return dict(enumerate(texts, start=5))


def test_any_four_positions_hold_a_group():
    for wide in (False, True):
        groups = simhash.position_groups(wide)
        assert all(any(set(g) <= set(c) for g in groups) for c in combinations(range(8), 4))
    assert len(simhash.position_groups()) == 20


def test_equals_brute_force(spark):
    texts = made()
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(5, None, "x")], "doc_id long, text string, gone_id string")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_links_of_hot_and_random_fingerprints(spark):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(1 << 63))
    near = {centre}
    for _ in range(400):
        x = centre
        for b in rng.choice(64, rng.integers(0, 8), replace=False):
            x ^= 1 << int(b)
        near.add(x)
    values = sorted(near | {int(v) for v in rng.integers(0, 1 << 63, 400)})
    want = brute_components(dict(enumerate(values)))
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    for wide, hot in ((False, simhash.HOT_POSTING), (False, 20), (True, simhash.HOT_POSTING)):
        links = simhash.link_fingerprints(df, wide, hot)
        assert links.count() < 20 * len(values)
        assert groups_of(links, values) == sorted(grouped(want))
        counts = simhash.posting_counts(df, wide, hot).first()
        assert counts.met >= counts.reached > counts.linked > 0
        assert wide or counts.met > counts.reached  # the tally drops pairs that agree in three positions alone


def grouped(component_of):
    found = {}
    for i, c in component_of.items():
        found.setdefault(c, []).append(i)
    return [sorted(g) for g in found.values()]


def groups_of(links, values):
    roots = {r.node: r.root for r in components(links).collect()}
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    return sorted(grouped({i: roots.get(v, v) for i, v in enumerate(signed)}))


def test_a_posting_of_twenty_thousand_fingerprints(spark):
    rng = np.random.default_rng(9)
    shared = np.uint64(0xABCDEF0000000000)
    clusters = [rng.integers(0, 1 << 40, 1, dtype=np.uint64)[0] for _ in range(40)]
    values = set(int(v) for v in rng.integers(0, 1 << 40, 4000, dtype=np.uint64))
    while len(values) < 20_000:
        x = int(clusters[rng.integers(0, 40) if rng.random() < 0.3 else 0])
        for b in rng.choice(40, rng.integers(0, 7), replace=False):
            x ^= 1 << int(b)
        values.add(x)
    values = sorted(int(shared) | v for v in values)
    fp = np.array(values, dtype=np.uint64)
    parent = list(range(len(fp)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fp)):
        for j in (i + 1 + np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 4)).tolist():
            p, q = find(i), find(j)
            parent[max(p, q)] = min(p, q)
    want = sorted(grouped({i: find(i) for i in range(len(fp))}))
    assert 2 < len(want) < 20_000
    df = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp long")
    for hot in (simhash.HOT_POSTING, 1 << 20):
        links = simhash.link_fingerprints(df, False, hot)
        assert groups_of(links, values) == want
    assert simhash.postings(df, False).groupBy("bucket").count().agg({"count": "max"}).first()[0] < 20_000


def test_one_row_of_each_component_stays(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta iota", "one two three four five six seven eight nine"
    docs = spark.createDataFrame(
        [(1, a, "x"), (1, b, "y"), (2, a, "x"), (3, b, "z"), (None, a, "n"), (None, "quite another text that has no copy", "n"), (4, "a text alone", "k"), (4, "a text alone", "j"), (4, "a text alone", "j")],
        "doc_id long, text string, key_id string",
    )
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert sorted((r[0] or 0, r[1]) for r in rows) == [(0, "quite another text that has no copy"), (1, a), (1, b), (4, "a text alone")]
    again = simhash.keep_one(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in again)


def test_components_of_a_long_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(chain).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components(chain.limit(0)).count() == 0


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    docs = spark.createDataFrame([(None, "some words that are here"), (4, "some words that are here"), (None, "other words entirely now then")], "doc_id long, text string")
    rows = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert rows == {(None, 4), (4, 4), (None, None)}
