"""Components of a similarity join whose candidates meet in buckets, without pairing up a bucket's members.

Two items may be similar only if some bucket holds both. A first round tests each member against its bucket's pivot (the
member of the highest score, as its caller rates how central items are), best-supported pairs first, and the pivot leaves.
Buckets whose members are then not all in one component stay open. Their members meet in blocks of bounded size dealt over
the tasks. There, pairs in different components that small bitmaps cannot rule out (their bound is exact) are tested on
contents from mapped files, and links that join two components go out: no link between components is lost, and no task
gives more links than it has members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.common import drop_folder, freed, tidy, written
from tracewright.llm.components import connected
from tracewright.llm.store import Store
from tracewright.llm.textvec import mix

#: Members of an open bucket that are compared in one block.
BLOCK = 1024
#: Pairs tested together, and tested pairs that a task remembers.
CHUNK, REMEMBER = 4096, 200_000
#: Pieces in which arrays of fixed size are combined.
CUTS = 32


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def unblob(column: pa.Array, dtype) -> np.ndarray:
    """All values of a binary column end to end."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def split_by(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices) for each bucket in use, indices in their order."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), order[cut[b] : cut[b + 1]]


ENTRY_SCHEMA = "part int, keys binary, items binary, scores binary"


def entry_rows(keys: np.ndarray, items: np.ndarray, scores: np.ndarray, parts: int) -> pa.RecordBatch:
    """Entries (key, item, the item's score) dealt into parts by key."""
    rows = [(b, blob(keys[i]), blob(items[i]), blob(scores[i].astype(np.float32))) for b, i in split_by((mix(keys) % np.uint64(parts)).astype(np.int64), parts)]
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "keys", "items", "scores"])


def sorted_entries(keys: np.ndarray, items: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries by key, the key's highest score first, and the starts of keys (with the end)."""
    order = np.lexsort((items, -scores, keys))
    keys, items = keys[order], items[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (items[1:] != items[:-1])
    keys, items = keys[new], items[new]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys, items, np.concatenate((np.flatnonzero(first), [len(keys)]))


class Contents:
    """Items' sizes, bitmaps and (where ``whole``) contents in mapped files, dealt by item: bitmaps tell most pairs apart,
    contents the rest, ``chunk`` pairs at a time."""

    def __init__(self, folder: str, parts: int, width: int, whole: bool = True, chunk: int = CHUNK):
        self.folder, self.parts, self.width, self.whole, self.chunk, self.files = folder, parts, width, whole, chunk, {}

    def __getstate__(self):
        return {**self.__dict__, "files": {}}

    def write(self, contents: DataFrame) -> None:
        """Store rows (item, n, bits, content), of rows of one item one."""
        store, parts = Store(self.folder), self.parts

        def save(part: int, t: pa.Table) -> None:
            items, first = np.unique(t.column("item").to_numpy(), return_index=True)
            t = t.take(pa.array(first))
            self.save_marks(part, items, t.column("n").to_numpy(), unblob(t.column("bits"), np.uint64))
            store.save(f"{part}.at", np.concatenate(([0], np.cumsum(pc.binary_length(t.column("content")).to_numpy(), dtype=np.int64))))
            store.save(f"{part}.data", unblob(t.column("content"), np.uint8))

        @tidy
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # rows come sorted by part: one part is held at a time
            held, now, done = [], None, 0
            for batch in batches:
                at = batch.column(0).to_numpy()
                for part in np.unique(at).tolist():
                    if held and part != now:
                        save(now, pa.Table.from_batches(held))
                        held = []
                    now = part
                    held.append(batch.filter(pa.array(at == part)))
                done += batch.num_rows
            if held:
                save(now, pa.Table.from_batches(held))
            yield pa.RecordBatch.from_arrays([pa.array([done])], ["n"])

        dealt = contents.select(F.pmod("item", F.lit(parts)).cast("int").alias("part"), "item", "n", "bits", "content")
        with freed(contents.sparkSession):
            dealt.repartition("part").sortWithinPartitions("part").mapInArrow(rows, "n long").agg(F.sum("n")).collect()

    def save_marks(self, part: int, items: np.ndarray, n: np.ndarray, bits: np.ndarray) -> None:
        """Sizes and bitmaps of a part's items, which are sorted and distinct."""
        for kind, x in (("items", items), ("n", n), ("bits", bits)):
            Store(self.folder).save(f"{part}.{kind}", x)

    def _part(self, part: int):
        if part not in self.files:
            store, kinds = Store(self.folder), {"items": np.int64, "n": np.int64, "bits": np.uint64}
            if self.whole:
                kinds |= {"at": np.int64, "data": np.uint8}
            try:
                # plain views of the maps: pieces of a map cost more
                self.files[part] = {k: np.asarray(store.load(f"{part}.{k}", kind)) for k, kind in kinds.items()}
            except FileNotFoundError:
                self.files[part] = None
        return self.files[part]

    def of(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """known (bool), n and bits of items."""
        known, n, bits = np.zeros(len(items), bool), np.zeros(len(items), np.int64), np.zeros((len(items), self.width), np.uint64)
        for part, i, at in self._found(items):
            known[i], n[i], bits[i] = True, self.files[part]["n"][at], self.files[part]["bits"].reshape(-1, self.width)[at]
        return known, n, bits

    def content(self, items: np.ndarray) -> list[np.ndarray | None]:
        """The bytes of each item's content."""
        out: list[np.ndarray | None] = [None] * len(items)
        for part, i, at in self._found(items):
            cut, data = self.files[part]["at"], self.files[part]["data"]
            for k, a, b in zip(i.tolist(), cut[at].tolist(), cut[at + 1].tolist(), strict=True):
                out[k] = data[a:b]
        return out

    def _found(self, items: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for part, i in split_by(items % self.parts, self.parts):
            files = self._part(part)
            if files and len(keys := files["items"]):
                at = np.minimum(np.searchsorted(keys, items[i]), len(keys) - 1)
                hit = keys[at] == items[i]
                yield part, i[hit], at[hit]

    def near(self, a: np.ndarray, b: np.ndarray, may: Callable) -> np.ndarray:
        """Whether pairs may be similar."""
        items, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        known, n, bits = self.of(items)
        return maybe(known, n, bits, back[: len(a)], back[len(a) :], may)


def maybe(known: np.ndarray, n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray, may: Callable) -> np.ndarray:
    """Whether the pairs of places (i, j) may be similar by their sizes, then their bitmaps; unknown items may."""
    out = ~(known[i] & known[j])
    for k in range(0, len(i), 65536):
        a, b = i[k : k + 65536], j[k : k + 65536]
        s = np.flatnonzero(~out[k : k + 65536] & may(n[a], n[b], np.zeros(len(a), np.int64)))
        out[k + s] = may(n[a[s]], n[b[s]], np.bitwise_count(bits[a[s]] ^ bits[b[s]]).sum(1, dtype=np.int64))
    return out


STAR_SCHEMA = "a long, b long, support long, bucket long, item long"


def stars(entries: DataFrame, store: Contents, may: Callable) -> DataFrame:
    """The rows of star_rows for entries dealt by part."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(unblob(b.column(1), np.int64), unblob(b.column(2), np.int64), unblob(b.column(3), np.float32)) for b in batches if b.num_rows]
        if held:
            yield from star_rows(*(np.concatenate(x) for x in zip(*held, strict=True)), store, may)

    return entries.repartition("part").mapInArrow(rows, STAR_SCHEMA)


def star_rows(keys: np.ndarray, items: np.ndarray, scores: np.ndarray, store: Contents, may: Callable, by_pivot: bool = False) -> Iterator[pa.RecordBatch]:
    """Of the entries of a part: rows (a, b, support) of members with their bucket's pivot that may be similar, and rows
    (bucket, item) of the other members of buckets of three and more, each distinct set of them once a part. Where
    ``by_pivot``, buckets are named by their pivots, so those of one pivot are one."""
    keys, items, at = sorted_entries(keys, items, scores)
    size = np.diff(at)
    pivot = np.repeat(items[at[:-1]], size)
    pair = items != pivot
    if pair.any():
        ab, support = np.unique(np.stack([pivot[pair], items[pair]]), axis=1, return_counts=True)
        fit = store.near(ab[0], ab[1], may)
        ab, support = ab[:, fit], support[fit]
        yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1]), pa.array(support.astype(np.int64)), pa.nulls(len(support), pa.int64()), pa.nulls(len(support), pa.int64())], ["a", "b", "support", "bucket", "item"])
    with np.errstate(over="ignore"):
        own = mix(items.view(np.uint64))
        who = np.add.reduceat(own, at[:-1]) - own[at[:-1]] + size.astype(np.uint64)
    _, once = np.unique(who, return_index=True)
    once = once[size[once] >= 3]
    take = np.zeros(len(size), bool)
    take[once] = True
    big = np.repeat(take, size)
    big[at[:-1]] = False
    if big.any():
        rows = np.stack([pivot if by_pivot else np.repeat(who.view(np.int64), size), items])[:, big]
        if by_pivot:
            rows = np.unique(rows, axis=1)
        n = rows.shape[1]
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 3 + [pa.array(rows[0]), pa.array(rows[1])], ["a", "b", "support", "bucket", "item"])


def join_components(entries: DataFrame, contents: DataFrame, width: int, may: Callable, similar: Callable, folder: str) -> DataFrame:
    """(node, component) of items with a link. ``contents`` has item, n, a bitmap of ``width`` 64-bit words and content for
    each item; may(n_a, n_b, differing bits) is true for all similar pairs; similar(contents, i, j) tests pairs of places in
    a list of contents."""
    spark = entries.sparkSession
    store = Contents(f"{folder}/contents", int(spark.conf.get("spark.sql.shuffle.partitions")), width)
    store.write(contents)
    return star_components(written(stars(entries, store, may), f"{folder}/stars"), store, may, similar, folder)


def star_components(both: DataFrame, store: Contents, may: Callable, similar: Callable, folder: str, by_pivot: bool = False) -> DataFrame:
    """(node, component) of items with a link, from rows of star_rows (in ``folder``/stars) and the items' contents (in
    ``folder``/contents). Where buckets are named ``by_pivot``, those whose pivot is in another one join that, so that
    members who meet in many buckets are compared once or few times."""
    pairs = both.filter("a is not null").groupBy("a", "b").agg(F.sum("support").alias("support"))
    pairs = written(pairs, f"{folder}/pairs")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("support", -F.col("a"))).alias("a")).select("a", "b")
    links = written(tested(best, store, similar), f"{folder}/best-links")
    labels = written(connected(links, f"{folder}/best-cc"), f"{folder}/best-labels")

    def labelled(df: DataFrame, item: str, to: str) -> DataFrame:
        return df.join(labels.select(F.col("node").alias(item), F.col("component").alias(to)), item, "left").withColumn(to, F.coalesce(to, item))

    def add(found: DataFrame, name: str) -> None:
        """Merge the components that the links found join."""
        nonlocal labels
        found = written(found, f"{folder}/{name}-links")
        up = labelled(labelled(found, "a", "ca"), "b", "cb").filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        up = written(up, f"{folder}/{name}-up")
        if up.isEmpty():
            return
        moved = connected(up, f"{folder}/{name}-cc").select(F.col("node").alias("component"), F.col("component").alias("top"))
        seen = labels.union(moved.select(F.col("component").alias("node"), "component").join(labels, "node", "left_anti"))
        labels = written(seen.join(moved, "component", "left").select("node", F.coalesce("top", "component").alias("component")), f"{folder}/{name}-labels")

    rest = labelled(labelled(pairs.select("a", "b"), "a", "ca"), "b", "cb").filter("ca != cb").select("a", "b")
    add(tested(rest.join(best, ["a", "b"], "left_anti"), store, similar), "stars")
    members = labelled(both.filter("bucket is not null").select("bucket", "item").distinct(), "item", "component")
    open_ = members.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m")).filter("x != y").select("bucket", "m")
    members = written(members.join(open_, "bucket"), f"{folder}/open")
    if by_pivot and not members.isEmpty():
        into = members.groupBy("item").agg(F.min("bucket").alias("top")).select(F.col("item").alias("bucket"), "top")
        members = members.join(into, "bucket", "left").select(F.least("bucket", "top").alias("bucket"), "item", "component").distinct()
        members = written(members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")), "bucket"), f"{folder}/grouped")
    add(joining_links(members, store, may, similar), "open")
    # the labels are written, so what they were made of can go
    for name in ("contents", "stars", "pairs", "open", "grouped", *(f"{step}-{kind}" for step in ("best", "stars", "open") for kind in ("links", "up", "cc"))):
        drop_folder(both.sparkSession, f"{folder}/{name}")
    return labels


def tested(pairs: DataFrame, store: Contents, similar: Callable) -> DataFrame:
    """The similar ones of pairs (a, b), their contents read from the store."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in gathered(batches, store.chunk):
            items, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            keep = similar(store.content(items), back[: len(a)], back[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    # pairs are few bytes each and long to test, so they are not left to partitions by size (an order of columns in which they
    # are dealt already would be left as it is)
    return pairs.select("a", "b").repartition(store.parts, "b", "a").mapInArrow(rows, "a long, b long")


def gathered(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[np.ndarray]]:
    """The columns of rows, n rows at a time."""
    held, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, n):
            some = batch.slice(k, n)
            if held and size + some.num_rows > n:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size = [], 0
            held.append([c.to_numpy() for c in some.columns])
            size += some.num_rows
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


class Joined:
    """Sets of components found to be one, by their smallest name; components never met stand for themselves."""

    def __init__(self):
        self.top: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.top.get(x, x)) != x:
            self.top[x] = self.top.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.top[max(x, y)] = min(x, y)
        return True


def joining_links(members: DataFrame, store: Contents, may: Callable, similar: Callable) -> DataFrame:
    """Links (a, b) among a bucket's members (bucket, m, item, component) that join different components. A bucket is cut
    into blocks by item; every two blocks, and each block with itself, meet in one task, which compares bitmaps, tests what
    they leave, and gives a link only if its ends are not yet joined there: fewer links than members."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("item"), blocks)
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "item", "component")
    dealt = rows.repartition(store.parts, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, seen = Joined(), set()

        def links(groups: pa.RecordBatch | pa.Table, cut: np.ndarray) -> pa.RecordBatch | None:
            """Of whole groups that start and end at the places in cut."""
            low, high, own, items, comps = (groups.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
            uniq, back = np.unique(items, return_inverse=True)
            comp_of = np.zeros(len(uniq), np.int64)
            comp_of[back] = comps
            known, n, bits = store.of(uniq)
            found = [np.zeros((2, 0), np.int64)]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                for i, j in index_pairs(b - a):
                    i, j = i + a, j + a
                    ok = comps[i] != comps[j]
                    if low[a] != high[a]:
                        ok &= own[i] != own[j]
                    i, j = back[i[ok]], back[j[ok]]
                    if len(i) > 256:
                        fit = maybe(known, n, bits, i, j, may)
                        i, j = i[fit], j[fit]
                    found.append(np.stack([np.minimum(i, j), np.maximum(i, j)]))
            code = np.unique(np.concatenate(found, axis=1)[0] * len(uniq) + np.concatenate(found, axis=1)[1]) if len(uniq) else np.zeros(0, np.int64)
            i, j = code // max(len(uniq), 1), code % max(len(uniq), 1)
            fit = maybe(known, n, bits, i, j, may)
            i, j = i[fit], j[fit]
            out = []
            for k in range(0, len(i), store.chunk):
                # pairs that the links before have joined, and those tested before, need no test
                some = [(x, y) for x, y in zip(i[k : k + store.chunk].tolist(), j[k : k + store.chunk].tolist(), strict=True) if joined.find(int(comp_of[x])) != joined.find(int(comp_of[y])) and (int(uniq[x]), int(uniq[y])) not in seen]
                if not some:
                    continue
                x, y = np.array(some).T
                if len(seen) > REMEMBER:
                    seen.clear()
                seen.update(zip(uniq[x].tolist(), uniq[y].tolist(), strict=True))
                used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                keep = similar(store.content(uniq[used]), at[: len(x)], at[len(x) :])
                for u, v in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                    if joined.join(int(comp_of[u]), int(comp_of[v])):
                        out.append((int(uniq[u]), int(uniq[v])))
            if out:
                ends = list(zip(*out, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(ends[0], pa.int64()), pa.array(ends[1], pa.int64())], ["a", "b"])
            return None

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = np.stack([table.column(k).to_numpy() for k in range(3)])
            starts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1))
            # the last group may go on in the next batch
            if len(starts) > 1:
                if (out := links(table, starts)) is not None:
                    yield out
                held = table.slice(int(starts[-1])).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if (out := links(table, np.array([0, table.num_rows]))) is not None:
                yield out

    return dealt.mapInArrow(run, "a long, b long")


_TRIANGLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def index_pairs(m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j below m, in pieces of bounded size."""
    if m <= 64:
        if m not in _TRIANGLES:
            _TRIANGLES[m] = np.triu_indices(m, 1)
        yield _TRIANGLES[m]
        return
    step = max(1, (1 << 18) // m)
    for a in range(0, m - 1, step):
        i, j = np.meshgrid(np.arange(a, min(a + step, m - 1)), np.arange(a + 1, m), indexing="ij")
        fit = i < j
        yield i[fit], j[fit]


def combined(partial: DataFrame, dtype, how) -> np.ndarray:
    """One array from partial ones of the same fixed size (one a task, column ``value``): cut into CUTS pieces that meet by
    number and combine where they meet, so that the driver gets one array's size whatever the number of tasks."""

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                for k, piece in enumerate(np.array_split(np.frombuffer(x.as_buffer(), dtype), CUTS)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob(piece)], pa.binary())], ["k", "value"])

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                value = np.frombuffer(x.as_buffer(), dtype)
                pieces[k] = how(pieces[k], value) if k in pieces else value.copy()
        for k, value in pieces.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob(value)], pa.binary())], ["k", "value"])

    schema = "k int, value binary"
    got = partial.mapInArrow(cut, schema).repartition("k").mapInArrow(meet, schema).collect()
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(bytes(r.value), dtype) for r in sorted(got, key=lambda r: r.k))])


def bitmap(rows_of_items: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each item's hash, in a map of fixed size: a Bloom filter with one hash. It may pass items that are not
    there, never drops one that is. ``column`` holds items as blobs."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for b in batches:
            for x in b.column(0):
                seen[bit_of(np.frombuffer(x.as_buffer(), np.int64), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["value"])

    found = combined(rows_of_items.select(column).mapInArrow(rows, "value binary"), np.uint8, np.bitwise_or)
    return found if len(found) else np.zeros(bits // 8, np.uint8)


def bit_of(items: np.ndarray, bits: int) -> np.ndarray:
    return (mix(items.view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def passes(found: np.ndarray, items: np.ndarray) -> np.ndarray:
    at = bit_of(items, len(found) * 8)
    return (found[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0
