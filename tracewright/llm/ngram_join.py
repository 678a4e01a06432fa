"""Components of documents whose word-5-gram sets have a Jaccard similarity of 0.8 or more.

Candidates must share prefix tokens under several token orders before their sets are compared:

1. Order by hash. A set's first n - ceil(0.8 n) + k tokens (k = ceil(n / 10)) hold at least k' of the like prefix of any
   similar set (k' is k for the smallest such set), so a set of whose prefix fewer tokens occur in other prefixes drops out.
2. Order by frequency, rarest first, over the whole remaining sets. Frequencies come from a sketch of fixed size, the same
   for all tasks, so the order is one order whatever the sketch's error. Similar sets share one of their first
   n - ceil(0.8 n) + 1 tokens; these are the buckets where candidates meet. Sets of frequent tokens are a bucket's pivots.
3. Two more orders of the whole set (other hashes): a candidate pair must share a prefix token in each, which bitmaps of
   the prefixes tell, before the sets are intersected.

Equal sets count as one item from the start. Null texts, and texts without words, have empty sets and link with nothing;
1 to 4 words form one shingle; texts of any length are taken whole. Rows of one doc_id are separate documents that share a
component by id only if linked; repeated rows are linked. Ties in an order go by token. An empty table gives no rows. Extra
columns, whatever their names, do not matter and stay in ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm import textvec as tv
from tracewright.llm.bucket_join import ENTRY_SCHEMA, bitmap, blob, combined, entry_rows, join_components, passes, split_by, unblob
from tracewright.llm.common import column, documents, shared_folder, small_batches, table, tidy, written

WORDS = 5
#: Bits of the map that picks the sets to fetch (2 MB), and of the prefix bitmaps of a set.
PICK_BITS, PREFIX_BITS = 1 << 24, 1024
PREFIX_BYTES = 2 * PREFIX_BITS // 8
#: Cells of the frequency sketch (8 MB).
SKETCH_CELLS = 1 << 21
#: Bytes of text whose sets are made together.
BATCH = 2 << 20
#: Items that a task remembers so as not to send a copy's prefix twice.
REMEMBER = 100_000
_OTHER_ORDERS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


def item_of(tokens: np.ndarray) -> int:
    """A set's 64-bit name, the same for equal sets."""
    with np.errstate(over="ignore"):
        return int(tv.mix(tv.mix(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])


def least_overlap(n):
    """What any similar set shares with a set of n tokens."""
    return (8 * n + 9) // 10


def prefix_length(n):
    return n - least_overlap(n) + (n + 9) // 10


def least_shared(n):
    """What two such prefixes share, seen from the set of n tokens."""
    return (least_overlap(n) + 9) // 10


def prefix_bits(tokens: np.ndarray) -> np.ndarray:
    """Bitmaps of the prefixes under the other orders."""
    n = len(tokens)
    out = np.zeros((len(_OTHER_ORDERS), PREFIX_BITS), bool)
    for k, salt in enumerate(_OTHER_ORDERS):
        order = np.sort(tv.mix(tokens ^ salt))[: n - least_overlap(n) + 1]
        out[k, (order % np.uint64(PREFIX_BITS)).astype(np.int64)] = True
    return np.packbits(out)


def similar_sets(contents: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets i and j (places in a list of prefix bitmaps followed by tokens) meet under the other orders and are similar.

    Tokens that at least two of the sets hold are numbered, and sets become rows of bits over these numbers: the overlap of
    a pair is the count of bits in both rows.
    """
    prefixes = np.stack([c[:PREFIX_BYTES] for c in contents]).reshape(len(contents), len(_OTHER_ORDERS), -1)
    sets = [c[PREFIX_BYTES:].view(np.uint64) for c in contents]
    n = np.array([len(s) for s in sets])
    keep = (prefixes[i] & prefixes[j]).any(2).all(1) & (10 * np.minimum(n[i], n[j]) >= 8 * np.maximum(n[i], n[j]))
    at = np.flatnonzero(keep)
    if not len(at):
        return keep
    used, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
    x, y = back[: len(at)], back[len(at) :]
    owner = np.repeat(np.arange(len(used)), n[used])
    tokens = np.concatenate([sets[u] for u in used])
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    common = ~first
    common[:-1] |= ~first[1:]
    number = (np.cumsum(first & common) - 1)[common]
    owner = owner[common]
    both = np.zeros(len(at), np.int64)
    # the bits of so many numbers at a time stay within a few MB
    width = max(64, (32 << 20) // max(len(used), 1) // 64 * 64)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(number, [low, low + width])
        bits = np.zeros((len(used), -(-min(width, int(number[-1]) + 1 - low) // 64) * 64), bool)
        bits[owner[a:b], number[a:b] - low] = True
        rows = np.packbits(bits, axis=1).view(np.uint64)
        step = max(1, (4 << 20) // rows.shape[1] // 8)
        for k in range(0, len(at), step):
            both[k : k + step] += np.bitwise_count(rows[x[k : k + step]] & rows[y[k : k + step]]).sum(1, dtype=np.int64)
    keep[at] = 100 * both >= 80 * (n[i[at]] + n[j[at]] - both)
    return keep


def text_sets(column: pa.Array) -> list[np.ndarray]:
    return tv.row_sets(*tv.shingles(*tv.words(*tv.utf8(column)), WORDS))


def prefix_entries(docs: DataFrame, parts: int) -> DataFrame:
    """Order 1: each item's prefix tokens, dealt by token."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in small_batches(batches, limit=BATCH):
            items, sizes, tokens = [], [], []
            for s in text_sets(batch.column(1)):
                if not len(s) or (item := item_of(s)) in seen:
                    continue
                if len(seen) >= REMEMBER:
                    seen.clear()
                seen.add(item)
                items.append(item)
                sizes.append(len(s))
                tokens.append(s[: prefix_length(len(s))])
            if items:
                yield _by_item(np.array(items, np.int64), np.array(sizes, np.uint32), tokens, parts)

    return docs.mapInArrow(rows, "part int, items binary, sizes binary, counts binary, tokens binary")


def _by_item(items, sizes, tokens, parts) -> pa.RecordBatch:
    owner = np.repeat(np.arange(len(items)), [len(t) for t in tokens])
    tokens = np.concatenate(tokens)
    out = []
    for part, i in split_by((tv.mix(tokens) % np.uint64(parts)).astype(np.int64), parts):
        who, counts = np.unique(owner[i], return_counts=True)
        out.append((part, blob(items[who]), blob(sizes[who]), blob(counts.astype(np.uint32)), blob(tokens[i])))
    cols = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "items", "sizes", "counts", "tokens"])


def shared_tokens(entries: DataFrame, parts: int) -> DataFrame:
    """How many of an item's prefix tokens other items have too, by part of the tokens, dealt by item."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            if b.num_rows:
                counts = unblob(b.column(3), np.uint32)
                held.append((unblob(b.column(4), np.uint64), np.repeat(unblob(b.column(1), np.int64), counts), np.repeat(unblob(b.column(2), np.uint32), counts)))
        if not held:
            return
        tokens, items, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.lexsort((items, tokens))
        tokens, items, sizes = tokens[order], items[order], sizes[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (items[1:] != items[:-1])
        tokens, items, sizes = tokens[new], items[new], sizes[new]
        alone = np.ones(len(tokens), bool)
        same = tokens[1:] == tokens[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        items, at, counts = np.unique(items[~alone], return_index=True, return_counts=True)
        sizes = sizes[~alone][at]
        for part, i in split_by((items.view(np.uint64) % np.uint64(parts)).astype(np.int64), parts):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([blob(x)], pa.binary()) for x in (items[i], sizes[i], counts[i].astype(np.uint32)))], ["part", "items", "sizes", "counts"])

    return entries.repartition("part").mapInArrow(rows, "part int, items binary, sizes binary, counts binary")


def candidates(shared: DataFrame) -> DataFrame:
    """Items with enough shared tokens, as blobs."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(unblob(b.column(1), np.int64), unblob(b.column(2), np.uint32), unblob(b.column(3), np.uint32)) for b in batches if b.num_rows]
        if held:
            items, sizes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            items, at, back = np.unique(items, return_index=True, return_inverse=True)
            total = np.bincount(back, counts, len(items))
            yield pa.RecordBatch.from_arrays([pa.array([blob(items[total >= least_shared(sizes[at].astype(np.int64))])], pa.binary())], ["items"])

    return shared.repartition("part").mapInArrow(rows, "items binary")


def frequencies(sets: DataFrame) -> np.ndarray:
    """Counts of tokens over distinct sets in a table of fixed size; tokens that fall on one cell share its count."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(SKETCH_CELLS, np.uint32)
        for b in batches:
            for x in b.column(0):
                np.add.at(found, _cell(np.frombuffer(x.as_buffer(), np.uint64)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["value"])

    found = combined(sets.select("tokens").mapInArrow(rows, "value binary"), np.uint32, np.add)
    return found if len(found) else np.zeros(SKETCH_CELLS, np.uint32)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tv.mix(tokens + np.uint64(1)) % np.uint64(SKETCH_CELLS)).astype(np.int64)


def bucket_entries(sets: DataFrame, parts: int) -> DataFrame:
    """Order 2: the rarest-first prefix of each set, dealt by token. An item's score is its tokens' mean frequency."""
    known = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, items, scores = [], [], []
            for item, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(tokens)
                count = known.value[_cell(tokens)]
                take = n - least_overlap(n) + 1
                order = np.lexsort((tokens, count))[:take]
                keys.append(tokens[order].view(np.int64))
                items.append(np.full(take, item, np.int64))
                scores.append(np.full(take, count.mean(), np.float32))
            if keys:
                yield entry_rows(np.concatenate(keys), np.concatenate(items), np.concatenate(scores), parts)

    return sets.select("item", "tokens").mapInArrow(rows, ENTRY_SCHEMA)


def items_and_sets(docs: DataFrame, pick: np.ndarray) -> DataFrame:
    """doc_id, mark, item (null for an empty set), size n; with the set and prefix bitmaps where the item may be a candidate."""
    pick = docs.sparkSession.sparkContext.broadcast(pick)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in small_batches(batches, limit=BATCH):
            sets = text_sets(batch.column(1))
            items = np.array([item_of(s) if len(s) else 0 for s in sets], np.int64)
            wanted = passes(pick.value, items) if len(items) else []
            blobs, bits = [], []
            for s, item, want in zip(sets, items.tolist(), wanted, strict=True):
                send = bool(want) and len(s) > 0 and item not in sent
                if send:
                    if len(sent) >= REMEMBER:
                        sent.clear()
                    sent.add(item)
                blobs.append(blob(s) if send else None)
                bits.append(blob(prefix_bits(s)) if send else None)
            empty = np.array([not len(s) for s in sets], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(items, pa.int64(), mask=empty), pa.array([len(s) for s in sets], pa.int64()), pa.array(blobs, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "mark", "item", "n", "tokens", "bits"]
            )

    return docs.mapInArrow(rows, "doc_id long, mark long, item long, n long, tokens binary, bits binary")


def set_contents(sets: DataFrame) -> DataFrame:
    """item, n, a bitmap of all its tokens, and its prefix bitmaps followed by its tokens."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, marks, content = [], [], []
            for x, prefix in zip(batch.column(1), batch.column(2), strict=True):
                tokens = np.frombuffer(x.as_buffer(), np.uint64)
                bits = np.zeros(PREFIX_BITS, bool)
                bits[(tv.mix(tokens) % np.uint64(PREFIX_BITS)).astype(np.int64)] = True
                size.append(len(tokens))
                marks.append(np.packbits(bits).tobytes())
                content.append(prefix.as_py() + x.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(marks, pa.binary()), pa.array(content, pa.binary())], ["item", "n", "bits", "content"])

    return sets.select("item", "tokens", "bits").mapInArrow(rows, "item long, n long, bits binary, content binary")


def may_be_similar(a, b, off):
    """Similar sets have like sizes. Each differing bit is a token that only one of them has: a ninth of their sum at most."""
    return (10 * np.minimum(a, b) >= 8 * np.maximum(a, b)) & (9 * off <= a + b)


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), n and component (null for an empty set) for each row of ``documents``."""
    spark = docs.sparkSession
    docs = documents(docs).withColumn("mark", F.xxhash64("text"))
    folder = shared_folder(spark, "ngram-join")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = written(candidates(shared_tokens(prefix_entries(docs, parts), parts)), f"{folder}/candidates")
    pick = bitmap(few, "items", PICK_BITS)
    known = written(items_and_sets(docs, pick), f"{folder}/items")
    sets = written(known.filter("tokens is not null").groupBy("item").agg(F.first("tokens").alias("tokens"), F.first("bits").alias("bits")), f"{folder}/sets")
    buckets = written(bucket_entries(sets, parts), f"{folder}/buckets")
    labels = join_components(buckets, set_contents(sets), PREFIX_BITS // 64, may_be_similar, similar_sets, f"{folder}/join")
    rows = known.select("doc_id", "mark", "item", "n").join(labels.withColumnRenamed("node", "item"), "item", "left")
    return rows.select("doc_id", "mark", "n", F.coalesce("component", "item").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) for each row of ``documents``.

    A null doc_id gives a null component unless a linked document has an id.
    """
    rows = grouped(docs)
    least = rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with just one row of each group: the first by doc_id (null last), then text hash, then all columns.
    Rows without words are in no group and stay."""
    folder = shared_folder(docs.sparkSession, "ngram-gone")
    rows = written(grouped(docs).filter("component is not null"), f"{folder}/rows")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    first = rows.groupBy("component").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    known = rows.join(first, "component").select("doc_id", "mark", rank.eqNullSafe(F.col("first")).alias("stays"))
    known = written(known.groupBy(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("m")), f"{folder}/known")
    # the documents' own columns stay apart from the working ones
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select(F.struct(*(column(c) for c in docs.columns)).alias("own"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(text).alias("own_mark"))
    on = F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_mark") == F.col("gone_mark"))
    # of rows equal in id and text all go, or one stays
    repeats = known.filter("stays and m > 1").select("gone_id", "gone_mark")
    out = marked.join(known.filter("not stays or m > 1").select("gone_id", "gone_mark"), on, "left_anti")
    if not repeats.isEmpty():
        once = marked.join(repeats, on, "left_semi").groupBy("own_id", "own_mark").agg(F.min_by("own", F.to_json("own")).alias("own"))
        out = out.select("own").unionByName(once.select("own"))
    return out.select(*(column(c, "own").alias(c) for c in docs.columns))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
