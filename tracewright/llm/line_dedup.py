"""Near-duplicate lines within an edit distance, and documents without their repeats.

Lines are cut at line feeds. Lines of equal text are one item. Two lines are alike within the edits that the shorter one's
length in code points allows: a tenth of it, rounded down, ``edits`` at most (MOST_EDITS, in the query and in the pipeline).

A line has h chunks of equal size from its start and h from its end, where 2 * h is more than its edits. Of two alike
lines, one end of the shorter holds fewer than h edits; there some chunk j, counted from that end, is whole and has just j
edits outside of it, so the other line has it at most j places away. h and the chunk size follow from length classes. A
line is entered under its own chunks, and probes, for its class and those of lengths within reach below it, the places
where a chunk may be: h * h an end and class. A chunk's key is taken from its run of ``anchor`` characters with the least
hash (short chunks: all of it), so that places next to each other mostly share one key and are entered once. Lines' own
chunks and a bitmap of each line are kept in mapped files first, with bit maps of the chunks: most probes name a place that
is no line's chunk, and are not sent. Where a probe or a chunk meets another line's chunk, lengths and bitmaps tell which
lines may be alike (their bound is exact); only of those the contents are kept, and their pairs are verified with a banded
bit-parallel edit distance.

Classes are connected components of alike lines. The first line of a class by doc_id (null first), line number, text
hash stays; later ones are repeats, those in repeated rows included: of rows equal in id and text one holds the lines that
stay. Blank lines are never repeats. Null and empty texts have no lines; an empty table gives no rows. Lines of any length
are taken whole. Extra columns, whatever their names, do not matter here and stay in ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm import textvec as tv
from tracewright.llm.bucket_join import STAR_SCHEMA, Contents, bitmap, blob, passes, split_by, star_components, star_rows
from tracewright.llm.common import column, drop_folder, freed, places, shared_folder, small_batches, table, tidy, written
from tracewright.llm.store import Store

#: Edits between alike lines: a tenth of the shorter one and so many at most. Keys grow with the square of that number.
MOST_EDITS, TENTH = 15, 10
PICK_BITS, MARK_BITS, MARK_CHARS = 1 << 24, 512, 4
#: Bits of a map for each chunk marked in it, and bits set for each.
OWNED_BITS, OWNED_TIMES = 10, 3
#: Pairs an entry up to which a key's pairs are told one by one; pairs of like lengths up to which a key's are looked at first.
MANY, LOOKED_AT = 16, 1 << 24
#: Pairs whose contents are compared together.
TESTED = 16384
#: Pairs that go through the band together, their characters, and the columns after which far ones leave it.
BAND_PAIRS, BAND_CHARS, BAND_STEP = 8192, 1 << 22, 32
#: Lines that a task remembers so as not to enter a repeat twice.
REMEMBER = 200_000
_CODE, _MARK_SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(64 - MARK_BITS.bit_length() + 1)


def allowed(length, most: int = MOST_EDITS) -> np.ndarray:
    """Edits within which a line of the given length is alike to one of its length or longer."""
    return np.minimum(np.asarray(length) // TENTH, most)


def chunks(length, most: int = MOST_EDITS) -> tuple[np.ndarray, np.ndarray]:
    """Chunks at each end, and their size, of lines of the given lengths. Sizes above 8 go in steps of a third to a half."""
    h = allowed(np.maximum(length, 0), most) // 2 + 1
    size = np.asarray(length) // (2 * h)
    step = 1 << np.maximum(np.frexp(size)[1] - 2, 0)
    return h, np.where(size > 8, size // step * step, size)


def anchor(width: int) -> int:
    """Characters of the run that stands for a chunk of the given size."""
    return width if width < 12 else max(10, 5 * width // 8)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance of two strings, or most + 1 if it is larger."""
    points = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (a, b)]
    return int(distances(points, np.array([0]), np.array([1]), most)[0])


def distances(lines: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of pairs of lines (code points), most + 1 for larger ones; ``most`` is 31 at most.

    Common ends go first. Then, for many pairs at once, bit vectors hold the steps of a band of 2 * most + 1 diagonals; the
    band moves down one row with each character of the second line, and the distance is followed along its lower edge.
    """
    out, size = np.full(len(i), most + 1), np.array([len(x) for x in lines], np.int64)
    if not len(i):
        return out
    lines = numbered(lines)
    near = np.flatnonzero(np.abs(size[i] - size[j]) <= most)
    # pairs of like lengths go together, so many that their characters are of bounded size
    near = near[np.argsort(-size[i[near]], kind="stable")]
    while len(near):
        n = max(1, min(BAND_PAIRS, BAND_CHARS // (int(size[i[near[0]]]) + 2 * most + 1)))
        some, near = near[:n], near[n:]
        out[some] = _near(lines, size, i[some], j[some], most)
    return out


def numbered(lines: list[np.ndarray]) -> list[np.ndarray]:
    """Lines with their characters numbered from 1, in the least type that has two numbers to spare."""
    flat = np.concatenate(lines)
    if not len(flat):
        return lines
    seen = np.zeros(int(flat.max()) + 1, bool)
    seen[flat] = True
    number, n = np.cumsum(seen), int(seen.sum())
    kind = np.uint8 if n < 254 else np.uint16 if n < 65534 else np.uint32
    flat, at = number.astype(kind)[flat], np.cumsum([0, *map(len, lines)]).tolist()
    return [flat[k:n] for k, n in zip(at[:-1], at[1:], strict=True)]


def _near(lines: list[np.ndarray], size: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Distances of pairs whose lengths are within ``most`` of each other."""
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = back[: len(i)], back[len(i) :]
    n = size[used]
    some = [lines[k] for k in used.tolist()]
    inside = np.arange(int(n.max(initial=0)) + 1) < n[:, None]
    ahead, behind = np.zeros(inside.shape, some[0].dtype), np.zeros(inside.shape, some[0].dtype)
    flat = np.concatenate(some)
    ahead[inside] = flat
    behind[::-1][inside[::-1]] = flat[::-1]
    # 0 stands behind each line's end, so lines that begin alike part there
    off = ahead[x] != ahead[y]
    start = np.where(off.any(1), off.argmax(1), n[x])
    off = behind[x] != behind[y]
    least = np.minimum(n[x], n[y])
    stop = np.minimum(np.where(off.any(1), off.argmax(1), n[x]), least - start)
    rows, cols = n[x] - start - stop, n[y] - start - stop
    out = np.maximum(rows, cols)
    live = np.flatnonzero((rows > 0) & (cols > 0))
    live = live[np.argsort(-cols[live], kind="stable")]
    if len(live):
        out[live] = _banded(ahead, x[live], y[live], start[live], rows[live], cols[live], most)
    return np.minimum(out, most + 1)


def _banded(text: np.ndarray, x: np.ndarray, y: np.ndarray, start: np.ndarray, rows: np.ndarray, cols: np.ndarray, most: int) -> np.ndarray:
    """Distances of so many characters from ``start`` on in rows x and y of a text, the longest ones of y first."""
    width = 2 * most + 1
    word = np.uint32 if width <= 32 else np.uint64
    one, mask, below = word(1), word((1 << width) - 1), word((1 << (width - 1)) - 1)
    out, ids = np.full(len(x), most + 1), np.arange(len(x))
    # matches are made for so many columns at once; what is left of them lies behind the longest line
    ended = -(-int(cols[0]) // BAND_STEP) * BAND_STEP
    # places outside of a line hold numbers that are no characters
    none = np.iinfo(text.dtype).max
    a = np.full((len(x), ended + width), none, text.dtype)
    b = np.full((len(x), ended), none - 1, text.dtype)
    for k, (p, q, at, m, n) in enumerate(zip(x.tolist(), y.tolist(), start.tolist(), rows.tolist(), cols.tolist(), strict=True)):
        a[k, most : most + m] = text[p, at : at + m]
        b[k, :n] = text[q, at : at + n]
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    # bit r of column t stands for row t - most + r (from 1); rows from 1 on rise by one in column 0
    up, down = np.full(len(x), mask & ~word((1 << most) - 1)), np.zeros(len(x), word)
    edge, done = np.full(len(x), most, np.int32), 0
    for t in range(ended):
        if t % BAND_STEP == 0:
            # a path of so few edits crosses this column within the band, at a distance that is no larger
            live = (cols > t) & (edge - _fall(up & below, down & below) <= most)
            if not live.all():
                rows, cols, up, down, edge, ids = (v[live] for v in (rows, cols, up, down, edge, ids))
                if not len(ids):
                    break
                a, b = a[t - done :, live], b[t - done :, live]
                done = t
            same = _matches(a[t - done : t - done + BAND_STEP + width], b[t - done : t - done + BAND_STEP], width, word)
            left = (len(cols) - np.searchsorted(cols[::-1], np.arange(t, t + BAND_STEP + 1), "right")).tolist()
        s = same[t % BAND_STEP]
        diagonal = (((s & up) + up) ^ up) | s | down
        diagonal &= mask
        edge += 1 - (diagonal >> word(width - 1)).astype(np.int32)
        plus = (down | ~(diagonal | up)) & mask
        minus = diagonal & up
        diagonal >>= one
        up = (minus | ~(diagonal | plus)) & mask
        down = diagonal & plus
        # of lines that end here, from the edge up to the last row
        here = slice(left[t % BAND_STEP + 1], left[t % BAND_STEP])
        if here.start < here.stop:
            beyond = below & (below << np.clip(rows[here] - t + most - 1, 0, width - 1).astype(word))
            d = edge[here] - np.bitwise_count(up[here] & beyond).astype(np.int64) + np.bitwise_count(down[here] & beyond)
            out[ids[here]] = np.minimum(d, most + 1)
    return out


def _matches(a: np.ndarray, b: np.ndarray, width: int, word) -> np.ndarray:
    """For each row of b a word whose bit r tells whether it is what stands r rows further in a."""
    out = np.zeros((*b.shape, np.dtype(word).itemsize), np.uint8)
    bits, same = np.empty(b.shape, np.uint8), np.empty(b.shape, bool)
    for k in range(0, width, 8):
        bits[:] = 0
        # the first of the eight ends up in the lowest bit
        for r in range(min(k + 8, width) - 1, k - 1, -1):
            np.equal(a[r : r + len(b)], b, out=same)
            np.add(bits, bits, out=bits)
            np.bitwise_or(bits, same.view(np.uint8), out=bits)
        out[:, :, k >> 3] = bits
    return out.view(word)[:, :, 0]


def _fall(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """How far the steps of each word fall at most, taken from the highest bit on, backwards."""
    now, most = np.zeros(len(up), np.int32), np.zeros(len(up), np.int32)
    size = up.dtype.itemsize
    up, down = up.view(np.uint8).reshape(-1, size), down.view(np.uint8).reshape(-1, size)
    for k in range(size - 1, -1, -1):
        at = up[:, k].astype(np.int32) << 8 | down[:, k]
        np.maximum(most, now + _FALLS[at], out=most)
        now += _STEPS[at]
    return most


def _falls() -> tuple[np.ndarray, np.ndarray]:
    """Of every eight steps, up and down: the sum, and the largest sum from the highest bit to any."""
    at = np.arange(1 << 16)
    step = np.array([(at >> (8 + k) & 1) - (at >> k & 1) for k in range(7, -1, -1)])
    return step.sum(0).astype(np.int32), np.maximum(step.cumsum(0).max(0), 0).astype(np.int32)


_STEPS, _FALLS = _falls()


def _codes(points: np.ndarray) -> np.ndarray:
    return tv.mix((points.astype(np.uint64) + np.uint64(1)) * _CODE)


_POINT_CODES = _codes(np.arange(1 << 16))


class Cut:
    """The lines of a batch: code points, each line's range, its document, and its 64-bit name."""

    def __init__(self, column: pa.Array):
        data, offsets = tv.utf8(column)
        self.text = data.tobytes().decode()
        self.points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        # of a character's bytes the first one counts
        rows = offsets - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), offsets)
        n = len(self.points)
        breaks = np.flatnonzero(self.points == 10)
        # every line begins at its row or after a break, and ends at the next break or its row's end
        size = np.diff(rows)
        filled = np.flatnonzero(size > 0)
        start = np.concatenate((rows[:-1][filled], breaks + 1))
        end = np.concatenate((rows[1:][filled], breaks))
        start, end = np.sort(start), np.sort(end)
        self.start, self.end = start, end
        inner = np.searchsorted(breaks, rows)
        self.count = np.where(size > 0, np.diff(inner) + 1, 0)
        self.size = end - start
        up, self.down = tv.powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        code = _POINT_CODES[self.points] if n and self.points.max() < len(_POINT_CODES) else _codes(self.points)
        with np.errstate(over="ignore"):
            code *= up[:n]
            np.cumsum(code, out=self.total[1:])
        self.item = self.hashes(self.start, self.size).view(np.int64)

    def hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return tv.mix((self.total[start + size] - self.total[start]) * self.down[start] + size.astype(np.uint64))

    def runs(self, start: np.ndarray, size: int) -> np.ndarray:
        """As hashes, for runs of one size that are compared with each other only."""
        with np.errstate(over="ignore"):
            return (self.total[start + size] - self.total[start]) * self.down[start]

    def line(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]


def probes(cut: Cut, lines: np.ndarray, most: int, only_own: bool = False, with_own: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the places where the lines may hold a chunk of an alike line of their length or shorter; the lowest bit marks
    a line's own chunks, to which ``only_own`` keeps and which are left out unless ``with_own``. Second, the line of each
    key."""
    length, found, before = cut.size[lines], [], np.full(len(lines), -1)
    for less in range(1 if only_own else most + 1):
        h, width = chunks(length - less, most)
        kind = h * (1 << 32) + width
        # classes are runs of lengths: each is probed once, at the first length of it
        new = np.flatnonzero((allowed(length - less, most) >= less) & (width > 0) & (kind != before))
        before[new] = kind[new]
        found.append((new, kind[new], np.full(len(new), less == 0)))
    line, kind, first = (np.concatenate(x) for x in zip(*found, strict=True))
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, lines.dtype)]
    order = np.argsort(kind, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else []:
        k = int(kind[some[0]])
        n, width = divmod(k, 1 << 32)
        if only_own:
            who, size = lines[line[some]], length[line[some]][:, None]
            step = np.arange(n) * width
            at = cut.start[who][:, None] + np.concatenate([np.broadcast_to(step, (len(some), n)), size - step - width], axis=1)
            code = tv.mix(np.array([_chunk_code(k, side, j) for side in range(2) for j in range(n)], np.uint64))
            with np.errstate(over="ignore"):
                keys.append((tv.mix(_least(cut, at, width)[:, :, 0] + code) | np.uint64(1)).ravel())
            owners.append(np.repeat(who, 2 * n))
            continue
        for side in range(2):
            for j in range(n):
                # places from j before to j after the chunk's own
                who = some if j or with_own else some[~first[some]]
                start, size, own = cut.start[lines[line[who]]], length[line[who]], first[who]
                place = size - (j + 1) * width if side else np.full(len(who), j * width)
                near = place[:, None] + np.arange(-j, j + 1)
                keep = (near >= 0) & (near + width <= size[:, None])
                low = _least(cut, (start + place - j)[:, None], width, 2 * j + 1)[:, 0]
                # equal neighbours are entered once, nearest to the chunk's own place
                if j:
                    same = (low[:, 1:] == low[:, :-1]) & keep[:, 1:] & keep[:, :-1]
                    keep[:, :j] &= ~same[:, :j]
                    keep[:, j + 1 :] &= ~same[:, j:]
                if not with_own:
                    keep[own, j] = False
                i, c = np.nonzero(keep)
                with np.errstate(over="ignore"):
                    made = tv.mix(low[i, c] + tv.mix(np.array([_chunk_code(k, side, j)], np.uint64)))
                keys.append(made & ~np.uint64(1) | (own[i] & (c == j)).astype(np.uint64))
                owners.append(lines[line[who[i]]])
    return np.concatenate(keys), np.concatenate(owners)


def _chunk_code(kind: int, side: int, j: int) -> int:
    return kind * 4096 + side * 2048 + j


def _least(cut: Cut, at: np.ndarray, width: int, places: int = 1) -> np.ndarray:
    """Hashes of the runs that stand for chunks of the given width from each of ``at`` (two axes) on, for so many places next
    to each other (third axis)."""
    run = anchor(width)
    span = width - run + 1
    at = at[:, :, None] + np.arange(places + span - 1)
    np.maximum(at, 0, out=at)
    low = cut.runs(np.minimum(at, len(cut.points) - run, out=at), run)
    while span > 1:
        step = span // 2
        low = np.minimum(low[:, :, : low.shape[2] - step], low[:, :, step:])
        span -= step
    return low


def line_marks(cut: Cut, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lines and a bitmap of each one's runs of MARK_CHARS characters (a row of 64-bit words). An edit takes so
    many runs away at most and brings as many at most, so it changes twice as many bits at most."""
    size = cut.size[lines]
    count = np.maximum(size - MARK_CHARS + 1, 0)
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        h = (cut.total[MARK_CHARS:] - cut.total[:-MARK_CHARS]) * cut.down[: max(len(cut.points) - MARK_CHARS + 1, 0)] >> _MARK_SHIFT
    bits = np.zeros(len(lines) * MARK_BITS, bool)
    at = np.arange(int(count.sum()))
    bits[h[at + np.repeat(cut.start[lines] - first, count)].view(np.int64) + np.repeat(np.arange(len(lines)) * MARK_BITS, count)] = True
    return size, np.packbits(bits).view(np.uint64).reshape(len(lines), MARK_BITS // 64)


_LINES = {"doc_id": pa.int64(), "mark": pa.int64(), "lines": pa.list_(pa.int64())}


class Owned:
    """Lines' own chunks (keys and items in order of the keys) and a bit map of their keys, for each part of the keys, and
    lines' lengths and bitmaps, in mapped files. A bit map may hold a key that is none, and lacks none that is one."""

    def __init__(self, folder: str, parts: int):
        self.folder, self.parts, self.maps = folder, parts, {}
        self.marks = Contents(f"{folder}/marks", parts, MARK_BITS // 64, whole=False)

    def __getstate__(self):
        return {**self.__dict__, "maps": {}}

    def write(self, docs: DataFrame, edits: int, folder: str = "") -> DataFrame | None:
        """Store the chunks and the bitmaps of rows (doc_id, text, mark); in ``folder``, where it is given, doc_id, mark and
        the items of the lines (null for blank ones) of each."""
        store, parts, marks = Store(self.folder), self.parts, self.marks

        @tidy
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, cut, once in new_lines(batches, edits, every=True):
                if folder:
                    yield lines_of(batch, cut, parts)
                keys, owner = probes(cut, once, edits, only_own=True)
                out = [(k, *row, None, None) for k, row in key_rows(cut, keys, owner, parts)]
                (size, bits), items = line_marks(cut, once), cut.item[once]
                out += [(k, None, blob(items[i]), None, blob(size[i].astype(np.int64)), blob(bits[i])) for k, i in split_by(items % parts, parts)]
                some = dealt(out, ["keys", "items", "counts", "n", "bits"])
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.nulls(len(some), t) for t in _LINES.values())], [*some.schema.names, *_LINES])

        @tidy
        def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[int, list] = {}
            line: dict[int, list] = {}
            for b in batches:
                own_rows = pc.is_valid(b.column("items"))
                yield b.filter(pc.invert(own_rows)).select(list(_LINES))
                for k, keys, items, counts, n, bits in zip(*b.filter(own_rows).columns[:6], strict=True):
                    items = np.frombuffer(items.as_buffer(), np.int64)
                    if keys.is_valid:
                        own.setdefault(k.as_py(), []).append((np.frombuffer(keys.as_buffer(), np.uint32), items, np.frombuffer(counts.as_buffer(), np.uint16)))
                    else:
                        line.setdefault(k.as_py(), []).append((items, np.frombuffer(n.as_buffer(), np.int64), np.frombuffer(bits.as_buffer(), np.uint64)))
            for k in sorted(line):
                items, n, bits = (np.concatenate(x) for x in zip(*line.pop(k), strict=True))
                items, at = np.unique(items, return_index=True)
                marks.save_marks(k, items, n[at], bits.reshape(-1, marks.width)[at])
            for k in sorted(own):
                keys, items, counts = (np.concatenate(x) for x in zip(*own.pop(k), strict=True))
                items = np.repeat(items, counts)
                both = np.sort(keys.astype(np.uint64) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64))
                keys = (both >> np.uint64(32)).astype(np.uint32)
                store.save(f"{k}.keys", keys)
                store.save(f"{k}.items", items[both.astype(np.uint32)])
                keys = keys[np.diff(keys, prepend=keys[:1] ^ np.uint32(2)) != 0]
                bits = np.zeros(len(keys) * OWNED_BITS, bool)
                for at in bits_of(keys, len(bits)):
                    bits[at] = True
                store.save(f"{k}.bits", np.packbits(bits, bitorder="little"))

        lines = "doc_id long, mark long, lines array<long>"
        sent = docs.mapInArrow(rows, f"part int, keys binary, items binary, counts binary, n binary, bits binary, {lines}")
        saved = sent.repartition("part").mapInArrow(save, lines)
        if folder:
            # rows get numbers in the written table, where they are fixed
            return written(saved.withColumn("row", F.monotonically_increasing_id()), folder)
        with freed(docs.sparkSession):
            saved.count()
        return None

    def chunks(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and items of a part's own chunks."""
        try:
            return Store(self.folder).load(f"{part}.keys", np.uint32), Store(self.folder).load(f"{part}.items", np.int64)
        except FileNotFoundError:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def holds(self, part: int, low: np.ndarray) -> np.ndarray:
        """Whether keys of a part may be those of lines' own chunks."""
        if part not in self.maps:
            try:
                self.maps[part] = Store(self.folder).load(f"{part}.bits", np.uint8)
            except FileNotFoundError:
                self.maps[part] = np.zeros(0, np.uint8)
        bits, left = self.maps[part], np.arange(len(low))
        if not len(bits):
            return np.zeros(len(low), bool)
        # a map of n chunks has OWNED_BITS * n bits, filled up to whole bytes
        for at in bits_of(low, len(bits) * 8 // OWNED_BITS * OWNED_BITS, lambda x: x[left]):
            left = left[bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 != 0]
        out = np.zeros(len(low), bool)
        out[left] = True
        return out


def bits_of(low: np.ndarray, size: int, taken=lambda x: x) -> Iterator[np.ndarray]:
    """The places of keys in a map, one of each key at a time, the mark of own chunks left out."""
    h = tv.mix((low >> np.uint32(1)).astype(np.uint64))
    for t in range(OWNED_TIMES):
        x = taken(h)
        yield (((x & np.uint64(0xFFFFFFFF)) + np.uint64(t) * (x >> np.uint64(32) | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (tv.mix(keys >> np.uint64(1)) % np.uint64(parts)).astype(np.uint16 if parts < 65536 else np.int64)


def new_lines(batches: Iterator[pa.RecordBatch], edits: int, every: bool = False) -> Iterator[tuple[pa.RecordBatch, Cut, np.ndarray]]:
    """Batches, cut into lines, and which of these may have an alike one and did not come before; batches without such only
    for ``every``."""
    seen: set[int] = set()
    for batch in small_batches(batches, limit=1 << 20):
        cut = Cut(batch.column(1))
        _, once = np.unique(cut.item, return_index=True)
        once = once[allowed(cut.size[once], edits) > 0]
        fresh = np.array([x not in seen for x in cut.item[once].tolist()], bool)
        once = once[fresh]
        if len(seen) > REMEMBER:
            seen.clear()
        seen.update(cut.item[once].tolist())
        if every or len(once):
            yield batch, cut, once


def key_rows(cut: Cut, keys: np.ndarray, owner: np.ndarray, parts: int, stays=None) -> Iterator[tuple[int, tuple[bytes, bytes, bytes]]]:
    """Keys by part: the low half of each (the part tells more, and keys that meet by chance are told apart when their lines
    are compared), items, and how many keys each item has in a row."""
    for k, i in split_by(part_of(keys, parts), parts):
        low = keys[i].astype(np.uint32)
        if stays:
            stay = stays(k, low)
            low, i = low[stay], i[stay]
        if len(i):
            order = np.argsort(owner[i], kind="stable")
            who, counts = runs(owner[i[order]])
            yield k, (blob(low[order]), blob(cut.item[who]), blob(counts.astype(np.uint16)))


def dealt(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of a part's number and binary columns of these names."""
    part, *columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], ["part", *names])


def probe_entries(docs: DataFrame, parts: int, edits: int, owned: Owned) -> DataFrame:
    """Rows of key_rows, dealt by key, of each line that may have an alike one: places other than its own chunks whose keys
    may be those of a line's own chunk."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cut, once in new_lines(batches, edits):
            keys, owner = probes(cut, once, edits, with_own=False)
            yield dealt([(k, *row) for k, row in key_rows(cut, keys, owner, parts, owned.holds)], ["keys", "items", "counts"])

    return docs.mapInArrow(rows, "part int, keys binary, items binary, counts binary")


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the runs of equal values."""
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(first)
    return x[at], np.diff(np.append(at, len(x)))


def met_lines(entries: DataFrame, parts: int, edits: int, owned: Owned, may) -> DataFrame:
    """Rows of star_rows for the buckets in which some line's own chunk and another line meet and may be alike."""
    # parts without probes have own chunks that meet
    every = entries.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"), *(F.lit(b"").alias(c) for c in ("keys", "items", "counts")))

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for k, *x in zip(*b.columns, strict=True):
                held.setdefault(k.as_py(), []).append([np.frombuffer(c.as_buffer(), t) for c, t in zip(x, (np.uint32, np.int64, np.uint16), strict=True)])
        # keys of two parts are not compared: each part stands for itself
        for k in sorted(held):
            low, items, counts = (np.concatenate(x) for x in zip(*held.pop(k), strict=True))
            own_low, own_items = owned.chunks(k)
            low, items = np.concatenate([own_low, low]), np.concatenate([own_items, np.repeat(items, counts)])
            ab, support, keys, items = near_entries(low, items, owned.marks, edits, may)
            if len(support):
                none = pa.nulls(len(support), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1]), pa.array(support.astype(np.int64)), none, none], ["a", "b", "support", "bucket", "item"])
            if len(keys):
                with np.errstate(over="ignore"):
                    keys = tv.mix(keys + np.uint64(k << 32)).view(np.int64)
                yield from star_rows(keys, items, np.zeros(len(keys), np.float32), owned.marks, may, by_pivot=True)

    return entries.unionByName(every).repartition("part").mapInArrow(rows, STAR_SCHEMA)


def near_entries(low: np.ndarray, items: np.ndarray, marks: Contents, edits: int, may) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of items (two rows, the smaller one first) that meet under a key which is an own chunk of one of them and that
    may be alike by length and bitmap, and under how many keys they do. Where a key has more than MANY such pairs an entry, keys and items of the entries in
    them instead; where it has more than LOOKED_AT pairs of like lengths, of all its entries."""
    # keys are sorted together with their places
    both = np.sort((low.astype(np.uint64) >> np.uint64(1) << np.uint64(32)) | np.arange(len(low), dtype=np.uint64))
    place = both.astype(np.uint32)
    both >>= np.uint64(32)
    edge = np.ones(len(both) + 1, bool)
    edge[1:-1] = both[1:] != both[:-1]
    # most keys are met by one line only
    some = np.flatnonzero(~(edge[:-1] & edge[1:]))
    keys, place = both[some], place[some]
    del both
    items, own = items[place], (low[place] & np.uint32(1)).astype(bool)
    uniq, who = np.unique(items, return_inverse=True)
    _, n, bits = marks.of(uniq)
    order = np.lexsort((~own, who, n[who], keys))
    keys, who, own = keys[order], who[order], own[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])
    keys, who, own = keys[new], who[new], own[new]
    size = n[who]
    least = allowed(size, edits)
    # lengths in a row: those of one key within the edits of a line come right after it
    row = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1]))[: len(keys)]) * (int(size.max(initial=0)) + edits + 1) + size
    reach = np.searchsorted(row, row + least, "right") - np.arange(len(row)) - 1
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    entries = np.diff(np.append(first, len(keys)))
    bucket = np.repeat(np.arange(len(first)), entries)
    dense = np.add.reduceat(reach, first) > LOOKED_AT if len(first) else np.zeros(0, bool)
    keep, count, found = dense[bucket], np.zeros(len(first), np.int64), [np.zeros((2, 0), np.int64)]
    left, off = np.flatnonzero((reach > 0) & ~keep), 1
    while len(left):
        # of dense keys it matters only which entries are in a pair
        t = left[(own[left] | own[left + off]) & ~(keep[left] & keep[left + off] & dense[bucket[left]])]
        for i in range(0, len(t), 65536):
            a = t[i : i + 65536]
            x, y = who[a], who[a + off]
            a = a[may(n[x], n[y], np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64))]
            keep[a] = keep[a + off] = True
            at = bucket[a]
            found.append(np.stack([a, a + off])[:, ~dense[at]])
            np.add.at(count, at, 1)
            dense[at] |= count[at] > MANY * entries[at]
        off += 1
        left = left[reach[left] >= off]
    pairs = np.concatenate(found, axis=1)
    pairs = np.sort(who[pairs[:, ~dense[bucket[pairs[0]]]]], axis=0)
    # items are in order, so their numbers are
    code, support = np.unique(pairs[0] * len(uniq) + pairs[1], return_counts=True)
    keep &= dense[bucket]
    return uniq[np.stack([code // max(len(uniq), 1), code % max(len(uniq), 1)])], support, keys[keep], uniq[who[keep]]


def lines_of(batch: pa.RecordBatch, cut: Cut, parts: int) -> pa.RecordBatch:
    """Rows of Owned.write: doc_id, mark, items of the lines (null for blank ones)."""
    at = np.concatenate(([0], np.cumsum(cut.count)))
    # a line is blank if it holds nothing but blanks and control characters
    solid = np.concatenate(([0], np.cumsum(cut.points > 32)))
    blank = solid[cut.end] == solid[cut.start]
    items = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(cut.item, pa.int64(), mask=blank))
    n = batch.num_rows
    part = pa.array((np.arange(n) + int(cut.item[0]) % parts if len(cut.item) else np.arange(n)) % parts, pa.int32())
    return pa.RecordBatch.from_arrays([part, *[pa.nulls(n, pa.binary())] * 5, batch.column(0), batch.column(2), items], ["part", "keys", "items", "counts", "n", "bits", *_LINES])


def line_contents(docs: DataFrame, pick: np.ndarray, edits: int) -> DataFrame:
    """Of lines that may be candidates, some more than once: item, length, bitmap, and the line in UTF-8."""
    pick = docs.sparkSession.sparkContext.broadcast(pick)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cut, once in new_lines(batches, edits):
            once = once[passes(pick.value, cut.item[once])]
            if not len(once):
                continue
            size, bits = line_marks(cut, once)
            content = [cut.line(i).encode() for i in once.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(cut.item[once]), pa.array(size), pa.array([blob(x) for x in bits], pa.binary()), pa.array(content, pa.binary())], ["item", "n", "bits", "content"])

    return docs.mapInArrow(rows, "item long, n long, bits binary, content binary")


def alike(edits: int):
    """A test of pairs of places in a list of lines: whether they are within the edits allowed."""

    def test(contents: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        lines = [np.frombuffer(c.tobytes().decode().encode("utf-32-le"), np.uint32) for c in contents]
        size = np.array([len(x) for x in lines])
        return distances(lines, i, j, edits) <= allowed(np.minimum(size[i], size[j]), edits)

    return test


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text ('' for null) and mark, a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def line_classes(docs: DataFrame, edits: int = MOST_EDITS) -> DataFrame:
    """One row for each non-blank line: doc_id, mark, row (a number of the document's row), line_no (from 0), the class's
    first line (class_doc_id, class_line_no), lines in the class, and whether this line stays."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "line-dedup")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = marked(docs)

    def may(a: np.ndarray, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        most = allowed(np.minimum(a, b), edits)
        return (np.abs(a - b) <= most) & (off <= 2 * MARK_CHARS * most)

    @tidy
    def met_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = np.concatenate([c.drop_null().to_numpy() for c in b.columns])
            yield pa.RecordBatch.from_arrays([pa.array([blob(items)], pa.binary())], ["items"])

    owned = Owned(f"{folder}/owned", parts)
    known = owned.write(docs, edits, f"{folder}/lines")
    texts = docs.select("doc_id", "text")
    met = written(met_lines(probe_entries(texts, parts, edits, owned), parts, edits, owned, may), f"{folder}/join/stars")
    drop_folder(spark, owned.folder)
    pick = bitmap(met.select("a", "b", "item").mapInArrow(met_items, "items binary"), "items", PICK_BITS)
    store = Contents(f"{folder}/join/contents", parts, MARK_BITS // 64, chunk=TESTED)
    store.write(line_contents(texts, pick, edits))
    labels = star_components(met, store, may, alike(edits), f"{folder}/join", by_pivot=True)
    rows = known.select("doc_id", "mark", "row", F.posexplode("lines").alias("line_no", "item")).filter("item is not null")
    rows = rows.join(labels.withColumnRenamed("node", "item"), "item", "left").withColumn("class", F.coalesce("component", "item"))
    rows = written(rows.select("doc_id", "mark", "row", "line_no", "class"), f"{folder}/classed")
    own = F.struct("doc_id", "line_no", "mark", "row")
    first = rows.groupBy("class").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("class_lines"))
    first = written(first.filter("class_lines > 1"), f"{folder}/first")
    rows = rows.join(first, "class", "left")
    return rows.select(
        "doc_id", "mark", "row", "line_no",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_doc_id"),
        F.when(F.col("first").isNull(), F.col("line_no")).otherwise(F.col("first.line_no")).alias("class_line_no"),
        F.coalesce("class_lines", F.lit(1)).alias("class_lines"),
        (F.col("first").isNull() | (own == F.col("first"))).alias("keep"),
    )


def without_repeats(docs: DataFrame, edits: int = MOST_EDITS) -> DataFrame:
    """The documents with repeated lines taken out, in their columns; n_chars follows where there is one. A document whose
    lines are all repeats goes, so of rows equal in id and text one stays at most (the least by all columns); others that
    lose lines keep the rest in order. Rows without lines stay."""
    names, folder = docs.columns, shared_folder(docs.sparkSession, "line-classes")
    classes = written(line_classes(docs, edits), f"{folder}/classes")
    by_row = classes.groupBy("doc_id", "mark", "row").agg(F.collect_list(F.when(~F.col("keep"), F.col("line_no"))).alias("lines"), F.max("keep").alias("some"))
    # rows equal in id and text: the first holds what stays
    known = by_row.groupBy("doc_id", "mark").agg(F.min_by("lines", "row").alias("lines"), F.min_by("some", "row").alias("some"), F.count(F.lit(1)).alias("rows"))
    known = written(known.filter("size(lines) > 0 or rows > 1"), f"{folder}/known")
    own, text = F.struct(*(column(c) for c in names)).alias("own"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked_ = docs.select(own, F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(text).alias("own_mark"))
    on = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_mark") == F.col("mark"))
    rest = marked_.join(known.filter("rows > 1").select("doc_id", "mark"), on, "left_anti")
    repeats = known.filter("rows > 1 and some")
    if not repeats.isEmpty():
        once = marked_.join(repeats.select("doc_id", "mark"), on, "left_semi").groupBy("own_id", "own_mark").agg(F.min_by("own", F.to_json("own")).alias("own"))
        rest = rest.unionByName(once)
    joined = rest.join(known.select("doc_id", "mark", "lines", "some"), on, "left").filter(F.coalesce("some", F.lit(True)))
    plain = places(docs)

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.columns, strict=False))
            texts, gone = columns["text"].to_pylist(), batch.columns[-1].to_pylist()
            changed = np.array([bool(g) for g in gone], bool)
            if changed.any():
                for i in np.flatnonzero(changed).tolist():
                    drop = set(gone[i])
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in drop)
                columns["text"] = pa.array(texts, columns["text"].type)
                if "n_chars" in columns:
                    sizes = pa.array([len(t) if c else None for t, c in zip(texts, changed, strict=True)]).cast(columns["n_chars"].type)
                    columns["n_chars"] = pc.if_else(pa.array(changed), sizes, columns["n_chars"])
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], plain)

    wide = joined.select(*(column(c, "own").alias(p) for c, p in zip(names, plain, strict=True)), F.col("lines").alias("gone_lines"))
    return wide.mapInArrow(cut, docs.toDF(*plain).schema).toDF(*names)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "class_doc_id", F.col("class_line_no").cast("long").alias("class_line_no"), "class_lines", "keep")
