"""Exact token ids of the lower-casing word-end BPE vocabulary, with a bounded cache of words.

The tokenizer cuts normalised text into pre-tokens that never span white space and encodes each on its own, so a word's
ids don't depend on its neighbours. Words are looked up in a cache. Unknown words of plain Latin characters are cut
into pre-tokens here and merged by the same vocabulary in tiktoken (which merges the adjacent pair of lowest rank, as
the tokenizer does); any other word (special-token marks, control characters, other scripts) goes to the tokenizer.
Tests hold the ids against the tokenizer's.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import types
import unicodedata

VOCABULARY = "word_bpe_49k.json"
END_OF_DOCUMENT = 1
#: Cached words of a worker; the cache starts anew beyond it, so its memory is bounded.
CACHE_ENTRIES = 500_000
#: Longer words aren't kept.
CACHE_BYTES = 64
#: Marks that often end a word.
STOPS = b".,;:!?"
#: No UTF-8 text holds this byte; it stands for the end of a word in the merged pieces.
WORD_END = b"\xff"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _plain(kind: str) -> str:
    """Lower-case characters below the combining marks whose Unicode category starts with kind, for a regular expression."""
    return "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == kind and chr(c) == chr(c).lower())


def _byte_characters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """encode(texts): each text's ids as little-endian unsigned 32-bit bytes, without the end-of-document id."""

    def __init__(self, vocabulary: str | None = None):
        from tokenizers import Tokenizer

        path = vocabulary or default_vocabulary()
        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        letters, numbers = _plain("L"), _plain("N")
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+").findall
        self.odd = re.compile("[^!-~¡-¬®-įı-ɏ]|<\\|").search
        self.merge = self._merger(path)

    def _merger(self, path: str):
        """encode_single_piece of the vocabulary in tiktoken, or None if its ids aren't in the order of its merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_characters()
        ranks: dict[bytes, int] = {}
        for piece, i in model["vocab"].items():
            body, end = (piece[:-4], WORD_END) if piece.endswith("</w>") and len(piece) > 4 else (piece, b"")
            if all(c in byte for c in body):
                ranks[bytes(byte[c] for c in body) + end] = i
        first = 2 * len(byte)
        whole = {piece: i for piece, i in model["vocab"].items()}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if whole.get(left + right) != first + rank:
                return None
        try:
            return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        except (AttributeError, ValueError):
            return None

    def _exact(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        if word[-1] in STOPS and word[-2:-1].isalnum() and len(word) <= CACHE_BYTES:
            # A mark right after a letter or digit is a pre-token of its own.
            return self._cached(word[:-1]) + self._cached(word[-1:])
        text = word.decode()
        if self.merge is None or self.odd(text):
            return self._exact(text)
        ids: list[int] = []
        for piece in self.cut(text.lower()):
            ids += self.merge(piece.encode() + WORD_END)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _cached(self, word: bytes) -> bytes:
        found = self.cache.get(word)
        if found is None:
            found = self.cache[word] = self._word(word)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            cache = self.cache
            if len(cache) > CACHE_ENTRIES:
                cache = self.cache = {}
            words = (text.lower() if text.isascii() else text).encode("utf-8", "replace").split()
            fresh = [w for w in set(words) if w not in cache]
            for word in fresh:
                if word not in cache:
                    cache[word] = self._word(word)
            out.append(b"".join(map(cache.__getitem__, words)))
            for word in fresh:
                if len(word) > CACHE_BYTES:
                    del cache[word]
        return out


def shared_encoder(vocabulary: str | None = None) -> Encoder:
    """The encoder of this process: a worker's tasks share its vocabulary and its bounded cache."""
    kept = sys.modules.setdefault("_plumbline_encoders", types.ModuleType("_plumbline_encoders")).__dict__
    path = vocabulary or default_vocabulary()
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
