"""An interpolated modified Kneser-Ney model of word n-grams, counted in Spark and looked up in memory-mapped arrays.

Counting: every batch's n-grams become (context, word) hashes, summed within the task and dealt by context. A bucket's
task adds the counts up, writes them as hash-sorted arrays to the shared folder, and sends on what the next lower order
counts: of each context's shorter form, every word once for each context it follows. The lowest order is dealt by word.
Discounts follow from counts of counts, a few numbers a bucket.

Model files of one order and bucket: sorted 64-bit n-gram hashes with 16-bit counts (larger ones apart, exact), and
sorted context hashes with their total and numbers of words seen once, twice, more often. Workers map the files where the
shared folder is a path; from other stores they read the buckets' files that they need into memory.

p(w | h) = max(c(hw) - D(c(hw)), 0) / c(h) + (D1 n1(h) + D2 n2(h) + D3 n3(h)) / c(h) * p(w | shorter h); at the end stands
the uniform distribution over the vocabulary and one unknown word. Each text begins after one start mark and ends with
one end mark, which counts as a token. Discounts are kept between 0.05 and k - 0.05, so that no probability is zero or
negative where a corpus has no counts of counts to go by.

Null and empty texts have the end mark alone; texts of any length are read whole. Equal rows, and ties of any kind, count
and score alike; a null doc_id is not held out. An empty table gives no rows, a model of nothing the uniform probability.
Extra columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm import textvec as tv
from tracewright.llm.bucket_join import blob, split_by, unblob
from tracewright.llm.common import crc_bucket, documents, shared_folder, small_batches, table, tidy
from tracewright.llm.store import Store

U64 = np.uint64
ORDER = 2
#: Hashes of the start and end marks, and of the empty context.
START, END, NOTHING = (tv.mix(np.array([k], U64) + U64(0xA5A5_0000_0000_0000))[0] for k in (1, 2, 3))
#: Counts above this are kept in a list of their own.
TOP = 65535
_FIELD = tv.mix(np.arange(1, 9, dtype=U64)) | U64(1)


def context(words: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the n words before each place of a padded sequence; n = 0 is the empty context."""
    with np.errstate(over="ignore"):
        h = np.full(len(at), NOTHING)
        for k in range(1, n + 1):
            h = tv.mix(h + words[at - k] * _FIELD[k - 1])
        return h


def gram(ctx: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tv.mix(ctx * _FIELD[7] + words)


def sequences(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts with ``order - 1`` start marks before and an end mark after each; places of tokens; each text's
    range of tokens."""
    h, counts = tv.words(*tv.utf8(column))
    size = np.diff(counts)
    tokens = np.concatenate(([0], np.cumsum(size + 1)))
    pad = order - 1
    shift = pad * np.arange(1, len(size) + 1)
    place = np.arange(tokens[-1]) + np.repeat(shift, size + 1)
    out = np.full(tokens[-1] + pad * len(size), START)
    last = tokens[1:] - 1 + shift
    word = np.ones(tokens[-1], bool)
    word[tokens[1:] - 1] = False
    out[place[word]] = h
    out[last] = END
    return out, place, tokens


def totals(*keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the key columns, sorted, with their number or summed weight."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    if weight is None:
        n = np.diff(np.concatenate((at, [len(order)])))
    else:
        n = np.add.reduceat(weight[order], at) if len(at) else np.zeros(0, np.int64)
    return [k[at] for k in keys], n.astype(np.int64)


def counted(ctx: np.ndarray, short: np.ndarray, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (context, word) rows, sorted, with their summed weight; the shorter form follows from the context."""
    order = np.lexsort((words, ctx))
    ctx, words = ctx[order], words[order]
    new = np.ones(len(order), bool)
    new[1:] = (ctx[1:] != ctx[:-1]) | (words[1:] != words[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(n[order], at) if len(at) else np.zeros(0, np.int64)
    return ctx[at], short[order[at]], words[at], total


# counts travel as rows of blobs: contexts, their shorter forms, words per context, words, counts
ROW = "part int, contexts binary, shorter binary, lengths binary, words binary, counts binary"


def _rows(ctx: np.ndarray, short: np.ndarray, words: np.ndarray, n: np.ndarray, part: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Sorted (context, word) counts as a row for each part."""
    for b, i in split_by(part, parts):
        c = ctx[i]
        first = np.ones(len(i), bool)
        first[1:] = c[1:] != c[:-1]
        at = np.flatnonzero(first)
        lengths = np.diff(np.concatenate((at, [len(i)])))
        big = n[i].max(initial=0) > TOP
        row = (blob(c[at]), blob(short[i][at]), blob(lengths.astype(np.uint32)), blob(words[i]), blob(n[i].astype(np.uint64 if big else np.uint16)))
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], ["part", "contexts", "shorter", "lengths", "words", "counts"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """All rows of a part added up: contexts, shorter forms, words, counts, sorted by context and word."""
    held = []
    for batch in batches:
        for _, ctx, short, lengths, words, counts in zip(*batch.columns, strict=True):
            lengths = np.frombuffer(lengths.as_buffer(), np.uint32)
            words = np.frombuffer(words.as_buffer(), U64)
            counts = counts.as_py()
            counts = np.frombuffer(counts, np.uint64 if len(counts) == 8 * len(words) else np.uint16).astype(np.int64)
            held.append((np.repeat(np.frombuffer(ctx.as_buffer(), U64), lengths), np.repeat(np.frombuffer(short.as_buffer(), U64), lengths), words, counts))
    if not held:
        return None
    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
    held.clear()
    return counted(*columns)


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (h % U64(parts)).astype(np.int64)


def count_batches(docs: DataFrame, order: int, parts: int) -> DataFrame:
    """Highest-order counts dealt by context, and plain word counts dealt by word (parts from ``parts`` on)."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=12 << 20):
            words, place, _ = sequences(batch.column(1), order)
            ctx, short = context(words, order - 1, place), context(words, order - 2, place)
            target = words[place]
            del words, place
            ctx, short, w, n = counted(ctx, short, target, np.ones(len(target), np.int64))
            yield from _rows(ctx, short, w, n, _part_of(ctx, parts), parts)
            del ctx, short
            (w,), n = totals(target)
            same = np.full(len(w), NOTHING)
            for r in _rows(same, same, w, n, _part_of(w, parts), parts):
                yield r.set_column(0, "part", shifted(r.column(0), parts))

    return docs.mapInArrow(rows, ROW)


def shifted(column: pa.Array, n: int) -> pa.Array:
    return pa.array(np.asarray(column) + n, pa.int32())


STATS = "level int, part int, n1 long, n2 long, n3 long, n4 long, types long, tokens long, row_part int, contexts binary, shorter binary, lengths binary, words binary, counts binary"
_NAMES = ["level", "part", "n1", "n2", "n3", "n4", "types", "tokens", "row_part", "contexts", "shorter", "lengths", "words", "counts"]


def _of_counts(level: int, part: int, n: np.ndarray) -> pa.RecordBatch:
    row = [level, part, *(int((n == k).sum()) for k in (1, 2, 3, 4)), len(n), int(n.sum())]
    types = [pa.int32(), pa.int32(), *[pa.int64()] * 6]
    return pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(row, types, strict=True)), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.binary())] * 5], _NAMES)


def save_level(store: Store, level: int, part: int, ctx: np.ndarray, words: np.ndarray, n: np.ndarray) -> None:
    grams = gram(ctx, words)
    order = np.argsort(grams)
    grams, c = grams[order], n[order]
    name = f"{level}/{part}"
    store.save(f"{name}.grams", grams)
    store.save(f"{name}.counts", np.minimum(c, TOP).astype(np.uint16))
    store.save(f"{name}.top", np.stack([grams[c >= TOP], c[c >= TOP].astype(U64)], 1) if len(c) else np.zeros((0, 2), U64))
    (keys,), total = totals(ctx, weight=n)
    stats = np.stack([total, *(totals(ctx, weight=(n == k).astype(np.int64))[1] for k in (1, 2)), totals(ctx, weight=(n > 2).astype(np.int64))[1]], 1) if len(ctx) else np.zeros((0, 4), np.int64)
    store.save(f"{name}.contexts", keys)
    store.save(f"{name}.stats", stats.astype(np.uint32 if total.max(initial=0) < 1 << 32 else np.uint64))


def _level_rows(batches: Iterator[pa.RecordBatch], folder: str, level: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Write a level's files; give counts of counts, and the next level's counts (dealt by context, in the end by word)."""
    found = _gathered(batches)
    if found is None:
        return
    ctx, short, words, n = found
    store = Store(folder)
    for part, i in split_by(_part_of(ctx, parts), parts):
        save_level(store, level, part, ctx[i], words[i], n[i])
        yield _of_counts(level, part, n[i])
    (c, w), k = totals(short, words)
    nothing = np.full(len(c), NOTHING)
    for r in _rows(c, nothing, w, k, _part_of(w if level == 2 else c, parts), parts):
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int32())] * 2, *[pa.nulls(1, pa.int64())] * 6, *r.columns], _NAMES)


def _word_rows(batches: Iterator[pa.RecordBatch], folder: str, level: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Write the files of single words (level 1: continuation counts, level 0: plain counts)."""
    found = _gathered(batches)
    if found is None:
        return
    _, _, words, n = found
    store = Store(folder)
    for part, i in split_by(_part_of(words, parts), parts):
        order = np.argsort(words[i])
        w, c = words[i][order], n[i][order]
        store.save(f"{level}/{part}.grams", w)
        store.save(f"{level}/{part}.counts", np.minimum(c, TOP).astype(np.uint16))
        store.save(f"{level}/{part}.top", np.stack([w[c >= TOP], c[c >= TOP].astype(U64)], 1))
        yield _of_counts(level, part, c)


def train(docs: DataFrame, order: int = ORDER) -> dict:
    """Count and write a model; its description is a few numbers an order. ``docs``: doc_id, text."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    folder = shared_folder(spark, "lm")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stats: list = []

    def told(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        back = spark.read.schema(STATS).parquet(f"{folder}/{name}")
        stats.extend(back.filter("level is not null").drop("row_part", "contexts", "shorter", "lengths", "words", "counts").collect())
        return back.filter("level is null").select(F.col("row_part").alias("part"), "contexts", "shorter", "lengths", "words", "counts")

    # one shuffle takes n-grams and words: parts below ``parts`` hold contexts, the others words
    lower = told(_top_level(count_batches(docs, order, parts).repartition("part"), folder, order, parts), f"rows-{order}")
    for level in range(order - 1, 0, -1):
        make = _word_rows if level == 1 else _level_rows

        @tidy
        def rows(batches: Iterator[pa.RecordBatch], make=make, level=level) -> Iterator[pa.RecordBatch]:
            for _, own in by_part(batches):
                yield from make(iter(own), folder, level, parts)

        lower = told(lower.repartition("part").mapInArrow(rows, STATS), f"rows-{level}")
    return describe(stats, folder, order, parts)


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each part of a task's share, one part after the other: only one is unpacked at a time."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        for i, part in enumerate(batch.column(0).to_pylist()):
            held.setdefault(part, []).append(batch.slice(i, 1))
    for part in sorted(held):
        yield part, held.pop(part)


def _top_level(counts: DataFrame, folder: str, order: int, parts: int) -> DataFrame:
    """The highest order and the plain word counts, from one shuffle."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in by_part(batches):
            yield from _level_rows(iter(own), folder, order, parts) if part < parts else _word_rows(iter(own), folder, 0, parts)

    return counts.mapInArrow(rows, STATS)


def describe(stats: list, folder: str, order: int, parts: int) -> dict:
    """Totals and discounts by level from the counts of counts."""
    model = {"folder": folder, "order": order, "parts": parts, "levels": {}}
    for level in range(order + 1):
        rows = [r for r in stats if r.level == level]
        n1, n2, n3, n4, types, tokens = (sum(r[k] for r in rows) for k in ("n1", "n2", "n3", "n4", "types", "tokens"))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        plain = [k - (k + 1) * y * b / a if a else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        model["levels"][level] = {"types": types, "tokens": tokens, "n": (n1, n2, types - n1 - n2), "discounts": [min(max(d, 0.05), k - 0.05) for k, d in enumerate(plain, 1)]}
    return model


class Lookup:
    """A worker's view of a model; files are mapped when first needed."""

    def __init__(self, model: dict):
        self.model, self.store, self.files = model, Store(model["folder"]), {}

    def array(self, name: str, dtype) -> np.ndarray:
        if name not in self.files:
            try:
                self.files[name] = self.store.load(name, dtype)
            except FileNotFoundError:
                self.files[name] = np.zeros(0, dtype)
        return self.files[name]

    def _found(self, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = np.flatnonzero(keys[i] == wanted)
        return hit, i[hit]

    def counts(self, level: int, keys: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Counts of n-grams (level > 1) or words, 0 where unknown; ``by`` deals them to parts."""
        out = np.zeros(len(keys), np.int64)
        for part, i in split_by(_part_of(by, self.model["parts"]), self.model["parts"]):
            i = i[np.argsort(keys[i], kind="stable")]
            name = f"{level}/{part}"
            hit, at = self._found(self.array(f"{name}.grams", U64), keys[i])
            c = np.asarray(self.array(f"{name}.counts", np.uint16)[at]).astype(np.int64) if len(at) else np.zeros(0, np.int64)
            if len(big := np.flatnonzero(c == TOP)):
                top = self.array(f"{name}.top", U64).reshape(-1, 2)
                c[big] = top[np.searchsorted(np.ascontiguousarray(top[:, 0]), keys[i][hit[big]]), 1].astype(np.int64)
            out[i[hit]] = c
        return out

    def contexts(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Rows (total, seen once, twice, more often); zeros where unknown."""
        out = np.zeros((len(keys), 4), np.int64)
        for part, i in split_by(_part_of(keys, self.model["parts"]), self.model["parts"]):
            i = i[np.argsort(keys[i], kind="stable")]
            known = self.array(f"{level}/{part}.contexts", U64)
            hit, at = self._found(known, keys[i])
            if len(at):
                raw = self.array(f"{level}/{part}.stats", np.uint8)
                out[i[hit]] = raw.view(np.uint32 if len(raw) == 16 * len(known) else np.uint64).reshape(-1, 4)[at].astype(np.int64)
        return out


def probabilities(look: Lookup, words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """p of each token of padded sequences."""
    model = look.model
    target = words[place]
    uniq, back = np.unique(target, return_inverse=True)
    p = None
    for level in range(1, model["order"] + 1):
        about = model["levels"][level]
        d = np.array([0.0, *about["discounts"]])
        if level == 1:
            c = look.counts(1, uniq, uniq)
            size = model["levels"][0]["types"]
            total = max(about["tokens"], 1)
            left = (d[1:] * about["n"]).sum() / total if about["tokens"] else 1.0
            p = (np.maximum(c - d[np.minimum(c, 3)], 0) / total + left / (size + 1))[back]
            continue
        ctx = context(words, level - 1, place)
        pairs, pair_back = np.unique(gram(ctx, target), return_index=True, return_inverse=True)[1:]
        c = look.counts(level, gram(ctx[pairs], target[pairs]), ctx[pairs])[pair_back]
        seen, seen_back = np.unique(ctx, return_inverse=True)
        rows = look.contexts(level, seen)
        total = np.maximum(rows[:, 0], 1)
        left = np.where(rows[:, 0] > 0, rows[:, 1:] @ d[1:] / total, 1.0)
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / total[seen_back] + left[seen_back] * p
    return p


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) for each row of (doc_id, text)."""
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    plain = model["levels"][0]

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model)
        for batch in small_batches(batches, limit=4 << 20):
            words, place, at = sequences(batch.column(1), model["order"])
            uniq, back = np.unique(words[place], return_inverse=True)
            c = look.counts(0, uniq, uniq)
            base = np.log10((c + 1) / (plain["tokens"] + plain["types"] + 1))[back]
            known = (c > 0)[back].astype(np.int64)
            p = np.log10(probabilities(look, words, place))
            # every text has its end mark, so no range is empty
            sums = [np.add.reduceat(x, at[:-1]) if batch.num_rows else x for x in (known, base, p)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(sums[0]), pa.array(np.full(batch.num_rows, plain["tokens"], np.int64)), pa.array(sums[1]), pa.array(sums[2])], names)

    return docs.mapInArrow(rows, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    held_out = F.coalesce(crc_bucket("doc_id", 7) == 2, F.lit(False))
    model = train(docs.filter(~held_out))
    return score(docs, model).withColumn("held_out", held_out).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
