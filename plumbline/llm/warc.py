"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding some records, then a footer: a skippable frame with the
seek table of the public seekable format (compressed and decompressed size of every frame, count, flags, magic number).
Its index maps a record identifier to the frame and the offset within the frame's decompressed bytes, so a record is
read by decompressing one frame. A bundle is a run of rows of a Parquet table in the shared folder, one a frame and one
for the footer: written through Spark's committer they are whole or absent when executors are lost, on any file system,
and a lookup loads the frames it needs alone. export_bundles joins the rows to plain files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, require, small

#: data is a frame, or the seek table (which has no records) as the last row of a bundle; offsets count decompressed bytes.
BUNDLE_SCHEMA = "bundle_id long, frame int, data binary, record_ids array<string>, offsets array<long>"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 16 << 20
#: Pages of one payload from which its response is broadcast to them, so that no task gathers them.
HOT_PAYLOAD = 100_000
LEVEL = 3
#: Written in every record: the archive's bytes depend on its rows alone, so a task that is run again writes the same.
DATE = "2000-01-01T00:00:00Z"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of every frame, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    at = len(archive) - 9 - entry * count
    found, start = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", archive, at + entry * i)
        found.append((start, packed, plain))
        start += packed
    return found


class BundleWriter:
    """Frames of a bundle: each add or close gives the rows (frame number, bytes, record ids, offsets) that are complete."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.pack, self.frame_bytes = zstandard.ZstdCompressor(level=level).compress, frame_bytes
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.ids: list[str] = []
        self.at: list[int] = []
        self.open_size = self.size = 0

    def add(self, record_id: str, record: bytes) -> list[tuple]:
        self.ids.append(record_id)
        self.at.append(self.open_size)
        self.open.append(record)
        self.open_size += len(record)
        return self.flush() if self.open_size >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.open:
            return []
        frame = self.pack(b"".join(self.open))
        row = (len(self.sizes), frame, self.ids, self.at)
        self.sizes.append((len(frame), self.open_size))
        self.size += len(frame)
        self.open, self.ids, self.at, self.open_size = [], [], [], 0
        return [row]

    def close(self) -> list[tuple]:
        rows = self.flush()
        return [*rows, (len(self.sizes), seek_table(self.sizes), [], [])]


def unpacked(frame: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(frame)


def read_frame(archive: bytes, frame: int) -> bytes:
    """The decompressed bytes of one frame of a whole archive, found by its seek table."""
    start, packed, _ = read_seek_table(archive)[frame]
    return unpacked(archive[start : start + packed])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page_id: int | str, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[str, bytes]:
    """A response record with its payload, or a revisit record without one. The length of a revisit's payload is a header too."""
    name = f"<urn:page:{page_id}>"
    safe = "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in (url or "urn:none").encode()).encode("latin-1").decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the end of the record that starts at a position."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    start = stop + 4
    end = start + int(headers["Content-Length"])
    body = data[start:end]
    return headers, body[body.index(b"\r\n\r\n") + 4 :], end + 4


def _sha(html) -> Column:
    return F.unhex(F.sha1(F.coalesce(html, F.lit("")).cast("binary")))


def record_kinds(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(revisit_id, revisit_sha, refers_to) of the pages that revisit another: equal payloads of at least min_bytes, all but the smallest page_id.

    Only digests are shuffled, and partly aggregated before; a digest that very many pages share is broadcast to them.
    """
    own = pages.select("page_id", _sha(F.col("html")).alias("sha"), F.octet_length(F.coalesce(F.col("html"), F.lit(""))).alias("size"))
    own = materialize(own.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha"))
    shared = own.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = materialize(shared.where("last > refers_to").select("sha", "refers_to", "n"))
    found = join_counted(own, shared, "sha", "n", HOT_PAYLOAD).where("page_id > refers_to")
    return found.select(F.col("page_id").alias("revisit_id"), F.col("sha").alias("revisit_sha"), "refers_to").distinct()


def write_bundles(pages: DataFrame, *, min_bytes: int = 0, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Bundles of all pages as a written table (BUNDLE_SCHEMA).

    Pages are written by the task that reads them, without a shuffle if the revisits are few. Null html is an empty
    payload, null url a placeholder; rows with the smallest page_id of a payload are responses even if repeated; rows that
    share a page_id are judged by their own payloads; a null page_id is response and has the identifier none; no pages
    give no bundle; other columns are ignored.
    """
    rows = require(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    kinds = small(materialize(record_kinds(rows, min_bytes)))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    typed = rows.select("page_id", "url", payload.alias("payload"), _sha(F.col("html")).alias("sha"))
    typed = typed.join(kinds, (F.col("page_id") == F.col("revisit_id")) & (F.col("sha") == F.col("revisit_sha")), "left")
    typed = typed.select("page_id", "url", "payload", "sha", "refers_to")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        writer, number = BundleWriter(frame_bytes), TaskContext.get().partitionId() << 36
        began = False

        def table(done: list[tuple]) -> Iterator[pd.DataFrame]:
            for frame, data, ids, offsets in done:
                yield pd.DataFrame({"bundle_id": [number], "frame": [frame], "data": [data], "record_ids": [ids], "offsets": [offsets]})

        for batch in batches:
            for page_id, url, data, sha, refers in zip(batch["page_id"], batch["url"], batch["payload"], batch["sha"], batch["refers_to"], strict=True):
                page = "none" if pd.isna(page_id) else int(page_id)
                began = True
                record = make_record(page, url if isinstance(url, str) else None, bytes(data), base64.b32encode(bytes(sha)).decode(), None if pd.isna(refers) else int(refers))
                yield from table(writer.add(*record))
                if writer.size >= bundle_bytes:
                    yield from table(writer.close())
                    writer, number, began = BundleWriter(frame_bytes), number + 1, False
        if began:
            yield from table(writer.close())

    return materialize(typed.mapInPandas(run, BUNDLE_SCHEMA))


def _number(name: str) -> int | None:
    found = name.removeprefix("<urn:page:").rstrip(">")
    return None if found == "none" else int(found)


def _records(frame: bytes, ids, offsets, payloads: bool) -> pd.DataFrame:
    """The records at some offsets of a frame as RECORD_SCHEMA, held against the index and their digests."""
    data, out = unpacked(frame), []
    for name, offset in zip(ids, offsets, strict=True):
        head, payload, _ = parse_record(data, offset)
        if head["WARC-Record-ID"] != name:
            raise ValueError(f"the index says {name}, the archive {head['WARC-Record-ID']}")
        refers = head.get("WARC-Refers-To")
        size, sha = int(head["X-Payload-Bytes"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
        if refers is None and (len(payload), base32_sha1(payload)) != (size, sha):
            raise ValueError(f"the payload of {name} is not what was written")
        out.append((_number(name), head["WARC-Target-URI"], size, sha, head["WARC-Type"], _number(refers) if refers else None, payload if payloads and refers is None else None))
    return pd.DataFrame(out, columns=[c.split()[0] for c in RECORD_SCHEMA.split(", ")]).astype({"refers_to": "Int64", "page_id": "Int64"})


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles, a frame at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame, ids, offsets in zip(batch["data"], batch["record_ids"], batch["offsets"], strict=True):
                yield _records(bytes(frame), ids, offsets, payloads)

    return bundles.where(F.size("record_ids") > 0).select("data", "record_ids", "offsets").mapInPandas(run, RECORD_SCHEMA)


def record_index(bundles: DataFrame) -> DataFrame:
    """(record_id, bundle_id, frame, offset) as a written table in order of the identifiers; the frames themselves aren't read."""
    rows = bundles.select("bundle_id", "frame", F.explode(F.arrays_zip("record_ids", "offsets")).alias("r"))
    rows = rows.select(F.col("r.record_ids").alias("record_id"), "bundle_id", "frame", F.col("r.offsets").alias("offset"))
    return materialize(rows.repartitionByRange("record_id", F.xxhash64("bundle_id", "frame", "offset")).sortWithinPartitions("record_id"))


def read_records(bundles: DataFrame, index: DataFrame, record_ids: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of some identifiers (column record_id): index, then frame, then offset. Identifiers that aren't there give no row.

    Only the frames that hold a wanted record are decompressed, each once.
    """
    places = index.join(small(record_ids.select("record_id").where("record_id is not null").distinct()), "record_id")
    per_frame = places.groupBy("bundle_id", "frame").agg(F.sort_array(F.collect_list(F.struct("offset", "record_id"))).alias("wanted"))
    found = bundles.select("bundle_id", "frame", "data").join(small(per_frame), ["bundle_id", "frame"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame, ids, offsets in zip(batch["data"], batch["ids"], batch["offsets"], strict=True):
                yield _records(bytes(frame), ids, offsets, payloads)

    return found.select("data", F.col("wanted.record_id").alias("ids"), F.col("wanted.offset").alias("offsets")).mapInPandas(run, RECORD_SCHEMA)


def export_bundles(bundles: DataFrame, folder: str | Path) -> list[str]:
    """Plain .warc.zst files with .idx files (record, frame, offset), written by the tasks; their paths.

    folder is a path that driver and executors share. A file gets its name when it is whole, so a task that is run again
    writes it anew.
    """
    folder = str(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for batch in batches:
            for bundle_id, rows in batch.groupby("bundle_id"):
                path = Path(folder) / f"{bundle_id:020d}.warc.zst"
                rows = rows.sort_values("frame")
                lines = [f"{n}\t{f}\t{o}\n" for f, ids, at in zip(rows["frame"], rows["record_ids"], rows["offsets"], strict=True) for n, o in zip(ids, at, strict=True)]
                for name, data in ((path.with_suffix(".idx"), "".join(lines).encode()), (path, b"".join(map(bytes, rows["data"])))):
                    part = name.with_name(f"{name.name}.{uuid.uuid4().hex}")
                    part.write_bytes(data)
                    part.replace(name)
                yield pd.DataFrame({"path": [str(path)]})

    def whole(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(run(iter([rows])))

    return sorted(r.path for r in bundles.groupBy("bundle_id").applyInPandas(whole, "path string").collect())  # a path for 16 MB


def digest(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
