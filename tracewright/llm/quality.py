"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are shares of kinds of characters, word shape and repetition, each also for the
line before and the line after; two weights a feature and a 2 x 2 table of transitions make up the field. Forward and
backward sums give each line's probability of being good, and a document's score is their mean by length.

The field is fitted on all lines of a bounded sample of labelled documents (TRAIN_DOCUMENTS a label); there, documents of
more than CHAIN lines stand as several chains. Only documents are labelled, so a bad document's lines start as bad, and a
first fit without transitions turns those that look good to good before the field is fitted.

Null, empty and blank texts have no lines and score EMPTY. Texts of any length are read whole. Rows are scored one by one:
repeated rows, and ties of any kind, score alike; a null doc_id is not held out. A document labelled twice counts as bad if
one label says so. Without labels of both kinds every text scores EMPTY and the filter keeps all; empty tables give no
rows. Extra columns do not matter, whatever their names, and stay in ``good_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm import textvec as tv
from tracewright.llm.common import crc_bucket, documents, places, small_batches, table, tidy

#: Labelled documents of each kind to fit on, and lines of a chain in fitting.
TRAIN_DOCUMENTS, CHAIN = 1500, 100
THRESHOLD = 0.3
#: The score of a text without lines.
EMPTY = 0.0
STEPS, RIDGE = 250, 1e-3
#: Bytes of text whose lines are described together.
BATCH = 2 << 20

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _OTHER, _HIGH = range(7)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = _LOWER, _UPPER, _DIGIT, _HIGH
_KIND[[9, 11, 12, 13, 32]] = _SPACE
_KIND[[*b".,;:'\"()-"]] = _STOP


@dataclass
class Lines:
    """Features of the non-blank lines of a batch; rows has each document's range, weight each line's length."""

    features: np.ndarray
    weight: np.ndarray
    rows: np.ndarray


def lines_of(column: pa.Array) -> Lines:
    data, offsets = tv.utf8(column)
    n = len(data)
    (hashes,), at, _ = tv.word_parts(data, offsets)
    cut = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    cut = cut[cut < n]
    if not len(at):
        return Lines(np.zeros((0, N_FEATURES), np.float32), np.zeros(0), np.zeros(len(offsets), np.int64))
    line_of_word = np.searchsorted(cut, at, "right") - 1
    used, inverse = np.unique(line_of_word, return_inverse=True)
    start = cut[used]
    end = np.append(cut, n)[used + 1]
    kinds = _KIND[data]
    counts = np.empty((len(used), 7))
    for k in range(7):
        total = np.concatenate(([0], np.cumsum(kinds == k, dtype=np.int64)))
        counts[:, k] = total[end] - total[start]
    letters = counts[:, _LOWER] + counts[:, _UPPER] + counts[:, _HIGH]
    size = np.maximum(counts.sum(1), 1)
    n_words = np.bincount(inverse, minlength=len(used))
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (inverse[1:] == inverse[:-1])
    with np.errstate(over="ignore"):
        pair = tv.mix(hashes + inverse.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, once = np.unique(pair, return_index=True)
    distinct = np.bincount(inverse[once], minlength=len(used))
    ends_stop = np.isin(data[np.maximum(end - 1 - (data[np.minimum(end, n) - 1] == 10), 0)], [46, 33, 63])
    own = np.stack(
        [
            counts[:, _LOWER] / size,
            counts[:, _UPPER] / size,
            counts[:, _UPPER] / np.maximum(letters, 1) > 0.5,
            counts[:, _DIGIT] / size,
            counts[:, _SPACE] / size,
            counts[:, _STOP] / size,
            counts[:, _OTHER] / size,
            np.minimum(counts[:, _OTHER] / n_words, 3),
            counts[:, _HIGH] / size,
            np.log1p(size) / 8,
            np.minimum(size / n_words, 30) / 10,
            np.bincount(inverse, same, len(used)) / n_words,
            distinct / n_words,
            1 - distinct / n_words > 0.5,
            n_words < 4,
            ends_stop,
        ],
        axis=1,
    ).astype(np.float32)
    doc = np.searchsorted(offsets, start, "right") - 1
    rows = np.searchsorted(doc, np.arange(len(offsets)))
    before, after = np.zeros_like(own), np.zeros_like(own)
    inner = doc[1:] == doc[:-1]
    before[1:][inner] = own[:-1][inner]
    after[:-1][inner] = own[1:][inner]
    first, last = np.ones((len(own), 1), np.float32), np.ones((len(own), 1), np.float32)
    first[1:][inner] = 0
    last[:-1][inner] = 0
    return Lines(np.concatenate([own, before, after, first, last, np.ones((len(own), 1), np.float32)], axis=1), size, rows)


N_FEATURES = 16 * 3 + 3


def chain(emit: np.ndarray, rows: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (lines, 2) and pair marginals summed (2, 2) of all chains at once, step by step along the lines."""
    size = np.diff(rows)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], rows[:-1][order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    forward, backward = np.zeros_like(emit), np.zeros_like(emit)
    for t in range(longest):
        i = start[: live[t]] + t
        a = emit[i]
        if t:
            a = a + np.logaddexp(forward[i - 1, :1] + trans[0], forward[i - 1, 1:] + trans[1])
        forward[i] = a - a.max(1, keepdims=True)
    pair = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        i = start[: live[t + 1]] + t
        step = emit[i + 1] + backward[i + 1]
        b = np.logaddexp(trans[:, 0] + step[:, :1], trans[:, 1] + step[:, 1:])
        backward[i] = b - b.max(1, keepdims=True)
        joint = forward[i][:, :, None] + trans + step[:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    both = forward + backward
    both = np.exp(both - both.max(1, keepdims=True))
    return both / both.sum(1, keepdims=True), pair


def fit(features: np.ndarray, rows: np.ndarray, label: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights (features, 2), transitions, and the features' means and scales, from documents' labels (one a chain)."""
    mean, scale = features.mean(0), features.std(0)
    mean[scale < 1e-6] = 0
    scale[scale < 1e-6] = 1
    x = (features - mean) / scale
    y = np.repeat(label, np.diff(rows)).astype(np.int64)
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))[:, None] * len(y)
    w, trans = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]

    def step(t: int, grads: list[np.ndarray]) -> None:
        for p, g, m, v in zip((w, trans), grads, moments[::2], moments[1::2], strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    for t in range(1, steps // 2 + 1):
        p = np.exp((e := x @ w) - e.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        step(t, [x.T @ ((p - np.eye(2)[y]) * share) / len(y) + RIDGE * w, np.zeros((2, 2))])
    # lines of bad documents that look good become good, but each bad document keeps its worst line as bad
    good = (e := x @ w)[:, 1] - e[:, 0]
    worst = np.zeros(len(y), bool)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if a < b:
            worst[a + int(np.argmin(good[a:b]))] = True
    y = np.where((y == 0) & (good > 0) & ~worst, 1, y)
    truth = np.eye(2)[y]
    inner = np.ones(len(y), bool)
    inner[rows[:-1][np.diff(rows) > 0]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    moments = [np.zeros_like(m) for m in moments]
    for t in range(1, steps + 1):
        p, pair = chain(x @ w, rows, trans)
        step(t, [x.T @ (p - truth) / len(y) + RIDGE * w, (pair - seen) / len(y) + RIDGE * trans])
    return w, trans, mean, scale


def scores(lines: Lines, model: tuple[np.ndarray, ...]) -> np.ndarray:
    w, trans, mean, scale = model
    p, _ = chain(((lines.features - mean) / scale) @ w, lines.rows, trans)
    total = np.concatenate(([0], np.cumsum(p[:, 1] * lines.weight)))
    weight = np.concatenate(([0], np.cumsum(lines.weight)))
    a, b = lines.rows[:-1], lines.rows[1:]
    return np.where(a < b, np.clip((total[b] - total[a]) / np.maximum(weight[b] - weight[a], 1), 0, 1), EMPTY)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, ...] | None:
    """Fit on a bounded sample of rows whose id does not fall in the held-out fifth; None without labels of both kinds."""
    known = labels.filter((crc_bucket("doc_id", 5) != 0) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    order = F.xxhash64("doc_id")
    sample = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(TRAIN_DOCUMENTS)
        sample = part if sample is None else sample.union(part)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=BATCH):
            found = lines_of(batch.column(1))
            parts = [found.features[a:b] for a, b in zip(found.rows[:-1], found.rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "y", "features"])

    # at most 2 * TRAIN_DOCUMENTS rows: safe to broadcast and to collect
    got = documents(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y").mapInArrow(rows, "doc_id long, y int, features binary").collect()
    got = sorted({(r.doc_id, r.y, bytes(r.features)) for r in got if len(r.features)})
    y = np.array([r[1] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    x = [np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES) for r in got]
    sizes = [[min(CHAIN, len(p) - k) for k in range(0, len(p), CHAIN)] for p in x]
    rows_ = np.concatenate(([0], np.cumsum([n for s in sizes for n in s])))
    return fit(np.concatenate(x).astype(float), rows_, np.repeat(y, [len(s) for s in sizes]))


def score_documents(docs: DataFrame, model: tuple[np.ndarray, ...] | None) -> DataFrame:
    """doc_id and score of each row; without a model every text scores EMPTY."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=BATCH):
            found = scores(lines_of(batch.column(1)), model.value) if model.value else np.full(batch.num_rows, EMPTY)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return documents(docs).mapInArrow(rows, "doc_id long, score double")


def good_documents(docs: DataFrame, model: tuple[np.ndarray, ...] | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score the threshold or more, in one pass; without a model all stay."""
    if model is None:
        return docs
    shared, names, extra = docs.sparkSession.sparkContext.broadcast(model), places(docs), "whole_text"

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, extra, BATCH):
            found = scores(lines_of(batch.column(batch.num_columns - 1)), shared.value)
            yield batch.select(names).filter(pa.array(found >= threshold))

    plain = docs.select("*", F.coalesce(F.col("text").cast("string"), F.lit(""))).toDF(*names, extra)
    return plain.mapInArrow(rows, docs.toDF(*names).schema).toDF(*docs.columns)


def line_labels(docs: DataFrame, model: tuple[np.ndarray, ...]) -> DataFrame:
    """The operator's line output: doc_id and each non-blank line's probability of being good, in order."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, trans, mean, scale = model.value
        for batch in small_batches(batches, limit=BATCH):
            found = lines_of(batch.column(1))
            p, _ = chain(((found.features - mean) / scale) @ w, found.rows, trans)
            good = pa.ListArray.from_arrays(pa.array(found.rows.astype(np.int32)), pa.array(p[:, 1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), good], ["doc_id", "good"])

    return documents(docs).mapInArrow(rows, "doc_id long, good array<double>")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
