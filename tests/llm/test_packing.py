import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import lengths, packing
from plumbline.llm.tokens import Encoder


@pytest.fixture(scope="module")
def encoder():
    return Encoder()


def exact(encoder, text):
    return np.asarray(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def made(seed=1, n=300):
    rng = random.Random(seed)
    letters = "abc XYZ'sé ÉßñÀİǅΣσς.,!#0189½²ªº\n\t\xa0\x85\x1c日本<|>"
    return [None, "", " \n ", "<|endoftext|> a", "a<|startoftext|>b", "it's we'll 'S", "x" * 5000, "word " * 9000, *["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]]


def test_encoder_gives_the_tokenizers_ids(encoder, spark, sf):
    texts = made() + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    assert encoder.merge is not None
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert got == exact(encoder, text), text


def check(rows, texts, encoder, max_tokens=2048, max_segments=256):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = exact(encoder, texts[doc_id]) + b"\x01\x00\x00\x00"
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids) // 4
            assert p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
        assert 4 * at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= max_tokens and len(pieces) <= max_segments
        total += at
        padding += 0 if at & (at - 1) == 0 else max_tokens - at
    return padding / max(1, total)


def test_round_trip_and_padding(spark, sf, encoder):
    texts = dict(enumerate(made()))
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, sequence_id int").coalesce(1)
    assert check(packing.digest(packing.pack_documents(docs)).collect(), texts, encoder) == 0
    table = spark.read.parquet(f"{sf}/documents.parquet").repartition(3, "doc_id")
    assert check(packing.digest(packing.pack_documents(table)).collect(), {r.doc_id: r.text for r in table.collect()}, encoder) == 0


def test_limits_hold(spark, encoder):
    docs = spark.createDataFrame([(i, "a b c") for i in range(100)], "doc_id long, text string").coalesce(1)
    pieces = packing.pack_documents(docs, max_tokens=64, max_segments=5, max_loss=12)
    rows = pieces.collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    assert sum(r.length for r in rows) == 400
    for own in by_sequence.values():
        assert len(own) <= 5 and sum(r.loss_tokens for r in own) <= 12 and sum(r.length for r in own) <= 64


def test_long_pieces_with_small_loss_limit():
    packer = packing.Packer(0, 32, 4, 8)
    packer.add(1, b"\0\0\0\0" * 100)
    packer.pack(0)
    assert sum(r[2] for r in packer.rows) == 100 and all(r[4] <= 8 for r in packer.rows)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty).count() == 0 and lengths.length_histogram(lengths.encoded_lengths(empty)).count() == 0
    rows = packing.digest(packing.pack_documents(spark.createDataFrame([(None, "a"), (1, None), (1, None)], "doc_id long, text string"))).collect()
    assert sorted((r.doc_id or -1, r.doc_tokens) for r in rows) == [(-1, 2), (1, 1), (1, 1)]


def test_histogram_equals_brute_force(spark, sf, encoder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [len(exact(encoder, r.text)) // 4 + 1 for r in docs.collect()]
    histogram = lengths.length_histogram(lengths.encoded_lengths(docs)).cache()
    rows = histogram.collect()
    assert sorted(r.length for r in rows) == sorted(set(sizes))
    for r in rows:
        assert (r.n_docs, r.n_tokens) == (sizes.count(r.length), r.length * sizes.count(r.length))
        assert (r.docs_at_least, r.tokens_at_least) == (sum(s >= r.length for s in sizes), sum(s for s in sizes if s >= r.length))
        assert (r.total_docs, r.total_tokens, r.rank_high) == (len(sizes), sum(sizes), sum(s <= r.length for s in sizes))
        assert r.truncated_total == sum(min(s, r.length) for s in sizes)
    assert lengths.truncated_total(histogram, 512).first()[0] == sum(min(s, 512) for s in sizes)
