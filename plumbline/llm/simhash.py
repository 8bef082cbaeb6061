"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints at most 4 bits apart agree in at least 4 of their 8 byte positions. The index posts every
distinct fingerprint under groups of positional bytes. A single positional byte would put 1/256 of all fingerprints
under one posting; the groups are triples of positions, chosen so that any 4 positions contain one of 20 triples (or
all 70 groups of 4 positions for very many fingerprints: another plan with the same links). Of the pairs that meet in a
posting the shared positional bytes are tallied, pairs below the guaranteed 4 matches are dropped, and only the rest is
verified by its differing bits; posting_counts tells how many pairs each step leaves. The tally is taken where a pair
meets, as counting its meetings over all postings would shuffle every pair of a hot posting.
A posting of very many fingerprints is posted anew under a fourth position, which every pair it must find shares too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, require, small
from .components import components

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
BYTES = 8
#: Two fingerprints within MAX_BITS agree in at least so many byte positions.
MATCHES = BYTES - MAX_BITS
#: Beyond so many distinct fingerprints postings are keyed by 4 bytes, as 2**24 keys would hold too many each.
WIDE_FROM = 1 << 26
#: A posting of more fingerprints is split by the byte at a further position.
HOT_POSTING = 1 << 13
#: Postings up to this size are compared pair by pair, larger ones star by star, BLOCK rows at once.
SMALL_POSTING, BLOCK = 64, 1024
#: Documents of a fingerprint from which its component is broadcast to them, so that no task gathers them.
HOT_COPIES = 100_000


def position_groups(wide: bool = False) -> list[tuple[int, ...]]:
    """Groups of byte positions such that any MATCHES positions contain one.

    Narrow: positions are dealt to three classes in a ring; a triple counts if it lies in one class, or two of its
    positions in one class and the third in the next. Of any four positions three always form such a triple.
    """
    if wide:
        return list(combinations(range(BYTES), MATCHES))
    ring = [0, 0, 0, 1, 1, 1, 2, 2]
    found = []
    for group in combinations(range(BYTES), 3):
        classes = [ring[p] for p in group]
        if len(set(classes)) == 1 or any(classes.count(c) == 2 and classes.count((c + 1) % 3) == 1 for c in set(classes)):
            found.append(group)
    return found


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a whole text."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= SHINGLE_WORDS:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - SHINGLE_WORDS + 1]
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)]
    n = len(hashes)
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), dtype=np.uint8)).reshape(n, 64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 255):
        counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", versions: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per row of docs. Null and wordless texts have 0.

    versions adds version, a hash of the text.
    """
    carried = ["doc_id", "version"] if versions else ["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.fromiter((fingerprint(t if isinstance(t, str) else None) for t in batch["text"]), dtype=np.uint64, count=len(batch))
            yield pd.DataFrame({c: batch[c] for c in carried} | {"fp": values.view(np.int64)})

    rows = require(docs, id_column, text_column).toDF("doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([F.xxhash64("text").alias("version")] if versions else []))
    return rows.mapInPandas(run, ", ".join(f"{c} long" for c in [*carried, "fp"]))


def shared_bytes(differ: np.ndarray) -> np.ndarray:
    """The tally: byte positions in which the two fingerprints of each pair (given as their exclusive or) agree."""
    fold = differ | (differ >> np.uint64(4))
    fold |= fold >> np.uint64(2)
    fold |= fold >> np.uint64(1)
    return BYTES - np.bitwise_count(fold & np.uint64(0x0101010101010101))


class _Postings:
    """Links within complete postings, each emitted under the first group of its positions only.

    Postings above SMALL_POSTING give a forest that connects what their links connect: its fingerprints are gathered in
    stars around pivots, then stars are compared as long as they aren't connected. So the work of a dense posting, of
    which one star holds nearly all, is linear, and what it emits always is. A link that isn't emitted here, as another
    group comes first, is made there, directly or over others, so connecting over it is right.
    """

    def __init__(self, groups: list[tuple[int, ...]]):
        self.masks = np.array([sum(0xFF << (8 * p) for p in g) for g in groups], dtype=np.uint64)
        self.met = self.reached = self.linked = 0

    def near(self, differ: np.ndarray) -> np.ndarray:
        """Which of the pairs that met are links: those that reach the guaranteed matches are verified, others dropped."""
        reached = np.flatnonzero(shared_bytes(differ) >= MATCHES)
        found = reached[np.bitwise_count(differ[reached]) <= MAX_BITS]
        self.met, self.reached, self.linked = self.met + len(differ), self.reached + len(reached), self.linked + len(found)
        return found

    def first(self, differ: np.ndarray, group: int | np.ndarray) -> np.ndarray:
        """Whether group is the first whose positional bytes agree."""
        mine = np.full(len(differ), -1)
        for g in range(len(self.masks) - 1, -1, -1):
            mine[(differ & self.masks[g]) == 0] = g
        return mine == group

    def stars(self, fp: np.ndarray) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
        """Members of each star, its pivot first, and the links between pivots and members."""
        found, links, free = [], [], np.arange(len(fp))
        while len(free):
            pivot, rest = free[0], free[1:]
            near = self.near(fp[rest] ^ fp[pivot])
            found.append(np.concatenate(([pivot], rest[near])))
            links += [(int(pivot), int(m)) for m in rest[near]]
            free = np.delete(rest, near)
        return found, links

    def forest(self, fp: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect every two of the fingerprints that links connect."""
        stars, links = self.stars(fp)
        stars.sort(key=len)
        label = np.empty(len(fp), dtype=np.int64)
        for k, members in enumerate(stars):
            label[members] = k
        order = np.concatenate(stars)
        end = 0
        for members in stars:
            end += len(members)
            rest = order[end:][::-1]  # the largest stars first
            while len(rest := rest[label[rest] != label[members[0]]]):
                part, rest = rest[:BLOCK], rest[BLOCK:]
                for at in range(0, len(members), BLOCK):
                    own = members[at : at + BLOCK]
                    part = part[label[part] != label[members[0]]]
                    if not len(part):
                        break
                    hit = self.near((fp[own][:, None] ^ fp[part][None, :]).ravel())
                    # One link to each connected part that is found.
                    left, right = own[hit // len(part)], part[hit % len(part)]
                    for k in np.unique(label[right], return_index=True)[1].tolist():
                        x, y = int(left[k]), int(right[k])
                        links.append((x, y))
                        label[label == label[y]] = label[x]
        return links

    def links(self, bucket: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """bucket is sorted; fp holds distinct fingerprints within a bucket."""
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        sizes = np.diff(np.concatenate((edge, [len(bucket)])))
        size_of = np.repeat(sizes, sizes)
        rank = np.arange(len(bucket)) - np.repeat(edge, sizes)
        group = bucket >> GROUP_SHIFT & 0xFF
        out_a, out_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]

        def emit(a: np.ndarray, b: np.ndarray, groups: int | np.ndarray) -> None:
            ok = self.first(a ^ b, groups)
            out_a.append(a[ok])
            out_b.append(b[ok])

        step = 1
        at = np.flatnonzero((size_of > 1) & (size_of <= SMALL_POSTING))
        while len(at := at[rank[at] + step < size_of[at]]):
            hit = at[self.near(fp[at] ^ fp[at + step])]
            emit(fp[hit], fp[hit + step], group[hit])
            step += 1
        large = sizes > SMALL_POSTING
        for start, size in zip(edge[large].tolist(), sizes[large].tolist(), strict=True):
            own = fp[start : start + size]
            pairs = np.array(self.forest(own), dtype=np.int64).reshape(-1, 2)
            emit(own[pairs[:, 0]], own[pairs[:, 1]], int(group[start]))
        return np.concatenate(out_a), np.concatenate(out_b)


#: A posting's number: packed bytes, then the group, then one more than the further position it was split by.
GROUP_SHIFT, SPLIT_SHIFT = 32, 40


def _byte(position: int):
    return F.shiftrightunsigned(F.col("fp"), 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _key(number: int, group: tuple[int, ...], further: int | None = None):
    packed = F.lit(0).cast("long")
    for position in [*group, *([] if further is None else [further])]:
        packed = F.shiftleft(packed, 8).bitwiseOR(_byte(position))
    return packed.bitwiseOR(F.lit((number << GROUP_SHIFT) | ((0 if further is None else 1 + further) << SPLIT_SHIFT)).cast("long"))


def postings(distinct: DataFrame, wide: bool, hot: int = HOT_POSTING) -> DataFrame:
    """(fp, bucket): every fingerprint under the groups of its positional bytes.

    A triple's posting with more than hot fingerprints is replaced by postings under the triple and each fourth position.
    """
    groups = position_groups(wide)
    posted = distinct.select("fp", F.explode(F.array(*[_key(n, g) for n, g in enumerate(groups)])).alias("bucket"))
    if wide:
        return posted
    large = materialize(posted.groupBy("bucket").count().where(F.col("count") > hot).select("bucket"))
    if large.isEmpty():
        return posted
    large = small(large)
    split = F.lit(None).cast("array<bigint>")
    for n, g in enumerate(groups):
        further = [_key(n, g, p) for p in range(BYTES) if p not in g]
        split = F.when(F.shiftrightunsigned("bucket", GROUP_SHIFT) == n, F.array(*further)).otherwise(split)
    again = posted.join(large, "bucket", "left_semi").select("fp", F.explode(split).alias("bucket"))
    return posted.join(large, "bucket", "left_anti").select("fp", "bucket").unionByName(again)


def _in_postings(distinct: DataFrame, wide: bool | None, hot: int, counts: bool) -> DataFrame:
    wide = distinct.count() > WIDE_FROM if wide is None else wide
    groups = position_groups(wide)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Postings(groups)
        bucket, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(b: np.ndarray, f: np.ndarray) -> Iterator[pd.DataFrame]:
            if len(b):
                left, right = index.links(b, f)
                if len(left) and not counts:
                    yield pd.DataFrame({"a": left.view(np.int64), "b": right.view(np.int64)})

        for batch in batches:
            bucket = np.concatenate((bucket, batch["bucket"].to_numpy(dtype=np.int64)))
            fp = np.concatenate((fp, batch["fp"].to_numpy(dtype=np.int64).view(np.uint64)))
            if len(bucket) < 100_000:
                continue
            ready = int(np.searchsorted(bucket, bucket[-1]))  # the last posting may go on in the next batch
            yield from found(bucket[:ready], fp[:ready])
            bucket, fp = bucket[ready:], fp[ready:]
        yield from found(bucket, fp)
        if counts:
            yield pd.DataFrame({"met": [index.met], "reached": [index.reached], "linked": [index.linked]})

    dealt = postings(distinct, wide, hot).repartition("bucket").sortWithinPartitions("bucket", "fp")
    return dealt.mapInPandas(run, "met long, reached long, linked long" if counts else "a long, b long")


def link_fingerprints(distinct: DataFrame, wide: bool | None = None, hot: int = HOT_POSTING) -> DataFrame:
    """(a, b): links that connect every two fingerprints (column fp) within MAX_BITS, directly or over others."""
    return _in_postings(distinct, wide, hot, counts=False)


def posting_counts(distinct: DataFrame, wide: bool | None = None, hot: int = HOT_POSTING) -> DataFrame:
    """One row: pairs that met in a posting and were tallied, that reached the guaranteed matches, that were verified."""
    own = _in_postings(distinct, wide, hot, counts=True)
    return own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in own.columns])


def _components(own: DataFrame) -> DataFrame:
    """own(doc_id, fp) -> (fp, first_id, n_docs, root, component_id) of every distinct fingerprint, as a written table."""
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_docs")))
    nodes = components(link_fingerprints(distinct.select("fp")))
    rooted = materialize(distinct.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "n_docs", F.coalesce("root", "fp").alias("root")))
    # Roots of links are few beside fingerprints; broadcast, the fingerprints of a large component meet in no task.
    linked = rooted.join(small(nodes.select(F.col("root").alias("linked")).distinct()), F.col("root") == F.col("linked"), "left_semi")
    least = small(linked.groupBy("root").agg(F.min("first_id").alias("least_id")))
    return materialize(rooted.join(least, "root", "left").select("fp", "first_id", "n_docs", "root", F.coalesce("least_id", "first_id").alias("component_id")))


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable over links).

    Exact copies share a fingerprint, which is indexed once however many documents have it. Null and wordless texts
    have fingerprint zero and link like any other; null ids have a component like any other row but never name one
    (null if no document of the component has an id); an empty table gives no row; other columns are ignored.
    """
    own = materialize(fingerprints(docs, id_column=id_column, text_column=text_column))
    # Only what several documents share or a link connects is joined; another document is its own component.
    named = _components(own).where((F.col("n_docs") > 1) | ~F.col("first_id").eqNullSafe(F.col("component_id")))
    rows = join_counted(own, named.select("fp", "n_docs", "component_id"), "fp", "n_docs", HOT_COPIES, "left")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("n_docs").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs, same columns, with one row of each component of near-duplicates.

    The row of the smallest id stays (a null id after all others); of texts that share that id the one of the smallest
    fingerprint and hash; of rows with equal id and text the one whose columns have the smallest hash. An id may have
    texts in several components: each keeps its own row.
    """
    version = F.xxhash64(docs[text_column])
    own = materialize(fingerprints(docs, id_column=id_column, text_column=text_column, versions=True))
    by_fp = _components(own).select("fp", "n_docs", "root")
    # Least row per fingerprint, then per component; fingerprints of one document that nothing links have nothing to lose.
    rank = lambda: F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "fp", F.col("version").alias("v"))
    per_fp = own.groupBy("fp").agg(F.min(rank()).alias("own_best")).join(by_fp, "fp")
    per_root = per_fp.groupBy("root").agg(F.min("own_best").alias("best"), F.sum("n_docs").alias("n"))
    shared = materialize(by_fp.join(per_root.where("n > 1"), "root").select("fp", "n_docs", "best"))
    judged = join_counted(own, shared, "fp", "n_docs", HOT_COPIES)
    stays = F.col("best.id").eqNullSafe(F.col("doc_id")) & (F.col("best.v") == F.col("version"))
    keys = materialize(judged.groupBy(F.col("doc_id").alias("key_id"), F.col("version").alias("key_version")).agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n")))
    same = lambda side: docs[id_column].eqNullSafe(side["key_id"]) & (version == side["key_version"])
    several = small(keys.where("stays and n > 1").select("key_id", "key_version"))
    decided = small(keys.where("not stays or n > 1").select("key_id", "key_version"))
    kept = docs.join(decided, same(decided), "left_anti")
    if keys.where("stays and n > 1").isEmpty():
        return kept
    names = docs.columns
    again = docs.join(several, same(several), "left_semi").toDF(*[f"c{i}" for i in range(len(names))])
    at_id, at_text = F.col(f"c{names.index(id_column)}"), F.col(f"c{names.index(text_column)}")
    whole = F.struct(*again.columns)
    one = again.groupBy(at_id.alias("key_id"), F.xxhash64(at_text).alias("key_version")).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row"))
    return kept.union(one.select("row.*").toDF(*names))
