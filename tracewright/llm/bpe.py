"""Byte-pair encoding and decoding over a vocabulary file with ranked merges and word ends.

A word's symbols form a doubly linked list. A heap holds one entry for each adjacent pair that has a merge rank; the
lowest rank (leftmost on ties) is merged first, and entries whose symbols have changed since are skipped as stale.
Decoding concatenates vocabulary strings with single spaces between tokens, as a file without a decoder asks.

Null and empty texts have no tokens. Very long texts are read whole, one text at a time. Of merges of equal rank the leftmost
goes first. Repeated rows and ids are rows of their own with equal values; an empty table gives no rows. Extra columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tracewright.llm.common import documents, table, tidy

#: Fixed value of the file format: how words are split. White space only separates, so collapsing it first changes nothing.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Characters that str.split() cuts at though the file's pattern does not count them as white space.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
#: Pieces, and words between blanks, whose ids a worker keeps; beyond it either memory starts afresh.
CACHE_PIECES, CACHE_WORDS = 400_000, 100_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max(*self.vocab.values(), *self.special.values(), 0) + 1)
        for s, i in {**self.vocab, **self.special}.items():
            self.strings[i] = s
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner = [self.vocab.get(letters[b]) for b in range(256)]
        self.final = [self.vocab.get(letters[b] + self.end) for b in range(256)]
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.whole: dict[str, bytes] = {}

    def normalize(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # str.lower() turns a final capital sigma into its final form; the file's normalizer maps each letter alone.
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges in rank order to one word. A heap entry is rank * length + place of the left symbol."""
        n = len(symbols)
        ranks, merged = self.ranks, self.merged
        before, after = [*range(-1, n - 1)], [*range(1, n), -1]
        heap = [r * n + i for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if j < 0 or ranks.get((symbols[i], symbols[j])) != r:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = merged[r], -1
            after[i], after[j] = (k := after[j]), -1
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, r * n + i)
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, r * n + h)
        return [s for s in symbols if s >= 0]

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        if (done := self.whole.get(piece)) is not None:
            return done
        *first, last = piece.encode()
        symbols = [x for b in first if (x := self.inner[b]) is not None]
        if (x := self.final[last]) is not None:
            symbols.append(x)
        if len(self.whole) >= CACHE_PIECES:
            self.whole.clear()
        ids = self.merge(symbols) if len(symbols) > 1 else symbols
        self.whole[piece] = done = array("I", ids).tobytes()
        return done

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out: list[bytes] = []
        cache, piece = self.cache, self.piece
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            part = self.normalize(part)
            if NOT_SPACE.search(part):
                out += map(piece, PIECE.findall(part))
                continue
            words = part.split()
            new = set(words).difference(cache)
            if len(cache) + len(new) > CACHE_WORDS:
                cache.clear()
                new = set(words)
            for w in new:
                cache[w] = piece(w) if w.isalpha() else b"".join(map(piece, PIECE.findall(w)))
            out.append(b"".join(map(cache.__getitem__, words)))
        return b"".join(out)

    def forget(self) -> None:
        """Give back the memory of words and pieces: a worker lives on after its task."""
        self.cache.clear()
        self.whole.clear()

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, special tokens included."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, read once in each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, 32-bit little-endian) and decoded text of every row of ``documents``."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [c.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([c.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])
        c.forget()

    return documents(docs).mapInArrow(rows, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded text, one row for each row of ``documents``."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py())
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    return documents(docs).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())
