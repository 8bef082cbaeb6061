"""Vector bin packing of token pieces into fixed-length sequences.

Every example is a vector (tokens, one segment, loss-bearing tokens). A sequence has a limit for each of the three. An
open sequence takes, again and again, the waiting piece with the largest dot product of its vector and the sequence's
remaining room (both relative to the limits) among those that fit. A document's prompt, its first line if others follow,
else its first token, bears no loss. Where no waiting piece fits and room for tokens is left, it is filled with the
start of a piece: of one with a long enough prompt where the sequence bears all the loss it may. What can't be filled
is cut into powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require
from .tokens import END_OF_DOCUMENT, shared_encoder

SCHEMA = "doc_id long, start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
#: Limits of a sequence of 2,048 tokens: 32 documents, and loss on at most 15 of 16 tokens.
MAX_SEGMENTS, MAX_LOSS = 32, 1920
#: Pieces waiting in a task at once: bounds its memory and the work of a choice.
WINDOW = 1024


@dataclass
class Piece:
    doc_id: object
    start: int
    ids: bytes
    doc_tokens: int
    #: Tokens at the piece's start that bear no loss.
    prompt: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def loss(self) -> int:
        return self.length - self.prompt

    def cut(self, tokens: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.ids[: 4 * tokens], self.doc_tokens, min(self.prompt, tokens)),
            Piece(self.doc_id, self.start + tokens, self.ids[4 * tokens :], self.doc_tokens, max(self.prompt - tokens, 0)),
        )


@dataclass
class Packer:
    """Packs one task's pieces; sequence ids start at first."""

    first: int
    max_tokens: int
    max_segments: int
    max_loss: int
    waiting: list[Piece] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)

    def emit(self, pieces: list[Piece]) -> None:
        offset, total = 0, sum(p.length for p in pieces)
        for p in pieces:
            self.rows.append((p.doc_id, p.start, p.length, p.ids, p.loss(), p.doc_tokens, self.first, offset, total))
            offset += p.length
        self.first += 1

    def add(self, doc_id: object, ids: bytes, prompt: int = 1) -> None:
        """A document's ids, of which the first prompt ones (one at least) bear no loss."""
        size = len(ids) // 4
        piece = Piece(doc_id, 0, ids, size, min(max(prompt, 1), size))
        while piece.length > self.max_tokens or piece.loss() > self.max_loss:
            part, piece = piece.cut(min(self.max_tokens, self.max_loss + piece.prompt))
            self.take(part)
        if piece.length:
            self.take(piece)
        if len(self.waiting) >= 2 * WINDOW:
            self.pack(WINDOW)

    def take(self, piece: Piece) -> None:
        if piece.length == self.max_tokens:
            self.emit([piece])
        else:
            self.waiting.append(piece)

    def pack(self, keep: int) -> None:
        """Close sequences until at most keep pieces wait (0: all)."""
        n = len(self.waiting)
        if not n:
            return
        pieces, left = self.waiting, n
        free = np.ones(n, dtype=bool)
        tokens = np.array([p.length for p in pieces], dtype=float)  # infinite once a piece is placed, so that it fits nowhere
        loss = np.array([p.loss() for p in pieces], dtype=float)
        prompts = np.array([p.prompt for p in pieces], dtype=float)
        while left > keep:
            chosen: list[Piece] = []
            gap, loss_room = self.max_tokens, self.max_loss

            def put(k: int, piece: Piece, rest: Piece | None) -> None:
                nonlocal gap, loss_room, left
                chosen.append(piece)
                gap, loss_room = gap - piece.length, loss_room - piece.loss()
                if rest is not None and rest.length:
                    pieces[k], tokens[k], loss[k], prompts[k] = rest, rest.length, rest.loss(), rest.prompt
                else:
                    free[k], tokens[k], left = False, np.inf, left - 1

            while left and len(chosen) < self.max_segments:
                # Every piece is one segment, so that part of the dot product is the same for all.
                fits = np.flatnonzero((tokens <= gap) & (loss <= loss_room))
                if not len(fits):
                    break
                score = tokens[fits] * (gap / self.max_tokens**2) + loss[fits] * (loss_room / self.max_loss**2)
                put(k := int(fits[score.argmax()]), pieces[k], None)
            while gap and left and len(chosen) < self.max_segments:
                # The start of a piece, as long as its prompt and the room for loss allow; of equal ones the longest piece.
                usable = np.where(free, np.minimum(gap, prompts + loss_room) + np.minimum(tokens, 2 * self.max_tokens) / (4 * self.max_tokens), -1.0)
                k = int(usable.argmax())
                size = min(gap, pieces[k].prompt + loss_room, pieces[k].length)
                if size <= 0:
                    break
                put(k, *pieces[k].cut(size))
            if gap:
                self.tail(chosen)
            else:
                self.emit(chosen)
        self.waiting = [p for p, f in zip(pieces, free, strict=True) if f]

    def tail(self, pieces: list[Piece]) -> None:
        """A partly filled sequence is cut into lengths that are powers of two, which need no padding."""
        rest, total = list(pieces), sum(p.length for p in pieces)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            taken: list[Piece] = []
            while room:
                piece = rest.pop(0)
                if piece.length > room:
                    piece, after = piece.cut(room)
                    rest.insert(0, after)
                taken.append(piece)
                room -= piece.length
            self.emit(taken)


def pack_documents(
    docs: DataFrame, *, vocabulary: str | None = None, max_tokens: int = 2048, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Pieces of all documents with the sequence and offset they were packed to.

    Each task packs the documents of its partition as they stream by, so nothing is shuffled and memory holds a window
    of pieces; a task that is run again gives the same pieces. Null and empty texts give the end-of-document id alone;
    repeated rows are packed each; an empty table gives no row; other columns are ignored. Padding is nowhere needed: a
    sequence is full or holds a power of two. With max_loss below max_tokens a full one needs prompts in its task; else
    more of the sequences are the powers of two.
    ids holds little-endian unsigned 32-bit ids, loss_tokens the piece's predicted tokens.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder = shared_encoder(vocabulary)
        end = np.asarray([END_OF_DOCUMENT], dtype="<u4").tobytes()
        packer = Packer((TaskContext.get().partitionId()) << 36, max_tokens, max_segments, max_loss)
        columns = [c.split()[0] for c in SCHEMA.split(", ")]

        def out() -> Iterator[pd.DataFrame]:
            while packer.rows:
                rows, packer.rows = packer.rows[:4096], packer.rows[4096:]
                yield pd.DataFrame(rows, columns=columns)

        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), [t if isinstance(t, str) else None for t in batch["text"]]
            for at in range(0, len(ids), 256):
                # No token spans a line's end, so a text's ids are those of its first line, then those of the others.
                lines = [t.partition("\n") if t else ("", "", "") for t in texts[at : at + 256]]
                heads, others = encoder.encode([x[0] for x in lines]), encoder.encode([x[2] for x in lines])
                for doc_id, head, rest in zip(ids[at : at + 256], heads, others, strict=True):
                    packer.add(None if doc_id is None or doc_id != doc_id else int(doc_id), head + rest + end, len(head) // 4 if rest else 1)
                yield from out()
        packer.pack(0)
        yield from out()

    rows = require(docs, id_column, text_column).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def closing_limits(pieces: DataFrame, max_tokens: int = 2048, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS) -> DataFrame:
    """One row: sequences, and how many of them have reached each limit."""
    own = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum("loss_tokens").alias("loss"))
    reached = {"tokens": max_tokens, "segments": max_segments, "loss": max_loss}
    return own.agg(F.count(F.lit(1)).alias("sequences"), *[F.coalesce(F.sum((F.col(c) >= v).cast("long")), F.lit(0)).alias(f"at_{c}") for c, v in reached.items()])
