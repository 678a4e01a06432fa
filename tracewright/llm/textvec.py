"""Word and n-gram hashes of whole Arrow string batches, computed with numpy over the UTF-8 bytes.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; A-Z count as a-z. A word's 64-bit hash is a
polynomial over its bytes, taken from prefix sums, so its cost is a few nanoseconds a byte whatever the word lengths.
Work goes in chunks that end at separators: memory follows the chunk (or the longest single word), not the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 20
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: a bijection under which close inputs land far apart."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers = np.ones(1, U64)
_inverse = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK)
        step, back = np.full(size, _BASE, U64), np.full(size, _BASE_INV, U64)
        step[0] = back[0] = 1
        _powers, _inverse = np.multiply.accumulate(step), np.multiply.accumulate(back)
    return _powers, _inverse


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each row's range in them (offsets, one more than rows)."""
    (hashes,), _, counts = word_parts(data, offsets)
    return hashes, counts


def word_parts(data: np.ndarray, offsets: np.ndarray, heads: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of all words, then of their first bytes for each length in heads; the words' places; each row's range."""
    cuts = _cuts(data, offsets)
    parts, places, counts, before = [[] for _ in range(1 + len(heads))], [], np.zeros(len(offsets), np.int64), 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first, last = np.searchsorted(offsets, [a, b])
        inner = offsets[first:last] - a
        chunk = data[a:b]
        start, end = _bounds(chunk, inner)
        low = LOWER[chunk]
        total = _running(low)
        parts[0].append(_span_hash(total, start, end))
        for k, n in enumerate(heads, 1):
            parts[k].append(_span_hash(total, start, np.minimum(start + n, end)))
        places.append(start + a)
        counts[first:last] = before + np.searchsorted(start, inner)
        before += len(start)
    counts[np.searchsorted(offsets, cuts[-1]) :] = before
    return [np.concatenate(p) if p else np.zeros(0, U64) for p in parts], np.concatenate(places) if places else np.zeros(0, np.int64), counts


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Positions at row starts or separators, about CHUNK apart."""
    cuts, at, n = [0], 0, len(data)
    while n - at > CHUNK:
        to = at + CHUNK
        row = offsets[np.searchsorted(offsets, to, "right") - 1]
        if row > at + CHUNK // 2:
            to = int(row)
        else:
            while to < n:
                near = np.flatnonzero(SEPARATOR[data[to : to + 4096]])
                if len(near):
                    to += int(near[0])
                    break
                to += 4096
            nxt = np.searchsorted(offsets, at, "right")
            if nxt < len(offsets) and at < offsets[nxt] <= min(to, n):
                rows = offsets[nxt : np.searchsorted(offsets, min(to, n), "right")]
                to = int(rows[-1])
        if to >= n:
            break
        cuts.append(to)
        at = to
    return [*cuts, n] if n > cuts[-1] else cuts


def _bounds(data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of one chunk; a row's start parts words."""
    inside = ~SEPARATOR[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    rows = row_starts[(row_starts > 0) & (row_starts < len(data))]
    start[rows] = inside[rows]
    end[rows - 1] = inside[rows - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _running(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte codes times powers of the base."""
    up, _ = powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return total


def _span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, equal for equal bytes wherever they stand."""
    _, down = powers(len(total))
    with np.errstate(over="ignore"):
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


_ORDER = mix(np.arange(1, 65, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of n words, with their offsets by row; shorter rows have none."""
    size = np.diff(counts)
    keep = np.maximum(size - n + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(keep)))
    if not offsets[-1]:
        return np.zeros(0, U64), offsets
    at = np.arange(offsets[-1]) + np.repeat(counts[:-1] - offsets[:-1], keep)
    with np.errstate(over="ignore"):
        h = hashes[at] * _ORDER[0]
        for k in range(1, n):
            h += hashes[at + k] * _ORDER[k]
    return mix(h + U64(n)), offsets


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """As ngrams, but a row of 1 to n-1 words has its whole sequence as one shingle."""
    h, offsets = ngrams(hashes, counts, n)
    size = np.diff(counts)
    short = np.flatnonzero((size > 0) & (size < n))
    if not len(short):
        return h, offsets
    whole = np.empty(len(short), U64)
    with np.errstate(over="ignore"):
        for i, r in enumerate(short):
            w = hashes[counts[r] : counts[r + 1]]
            whole[i] = mix((w * _ORDER[: len(w)]).sum(dtype=U64) + U64(len(w)))
    full = np.maximum(size - n + 1, 0)
    full[short] = 1
    out_at = np.concatenate(([0], np.cumsum(full)))
    out = np.empty(out_at[-1], U64)
    single = np.zeros(out_at[-1], bool)
    single[out_at[short]] = True
    out[single] = whole
    out[~single] = h
    return out, out_at


def row_sets(h: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each row."""
    return [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
