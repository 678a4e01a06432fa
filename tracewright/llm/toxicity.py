"""Toxicity categories predicted one after the other by a classifier chain.

Each link of the chain is a logistic model over the words of a text (and their first letters, so that unseen forms of a
known stem count) plus the probabilities of the categories before it. Training feeds a link the earlier categories'
out-of-fold predictions, as scoring will feed it predictions made without knowledge of the label.

The labels name one kind of toxicity; the chain's categories are that kind in each common language of the labelled toxic
documents, and last ``toxic`` itself, whose probability is the score. Languages only choose training targets: the score
of a text depends on its words alone.

The chain is fitted on the whole texts of a bounded sample (TRAIN_DOCUMENTS of each label). Its vocabulary and its documents
as rows of numbers are made once; each link keeps the features whose rates differ between the labels by CERTAIN standard
errors.

Null, empty and wordless texts have no features and get the chain's prior. Texts of any length are read whole. Repeated rows
and ties score alike; a null doc_id is not held out. A document labelled twice counts as toxic if one label says so. Without
labels every text gets one half; empty tables give no rows. Extra columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm import textvec as tv
from tracewright.llm.common import crc_bucket, documents, small_batches, table, tidy

TRAIN_DOCUMENTS = 3000
#: Bytes of a word's start that count as features of their own.
HEADS = (4, 6)
#: Documents of the sample that must hold a feature, and standard errors by which its rate differs between the labels:
#: with some hundred thousand features to choose from, fewer than one passes by chance.
LEAST_DOCUMENTS, CERTAIN = 4, 4.5
#: Toxic documents of the sample from which a language is a category of its own.
LANGUAGE_DOCUMENTS = 30
FOLDS, RIDGE = 3, 3e-3
#: A fit ends where no slope is steeper, or after as many steps; steps remembered for the next one's direction.
FLAT, STEPS, MEMORY = 1e-5, 200, 10
THRESHOLD = 0.4


def features_of(column: pa.Array) -> list[np.ndarray]:
    """The distinct word and word-start hashes of each text, punctuation around words included in the whole word only."""
    parts, _, counts = tv.word_parts(*tv.utf8(_plain(column)), HEADS)
    salted = [p ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k, p in enumerate(parts)]
    out = []
    for a, b in zip(counts[:-1], counts[1:], strict=True):
        out.append(np.unique(np.concatenate([p[a:b] for p in salted])))
    return out


#: ASCII characters other than letters, digits and the apostrophe part words here.
_PARTED = bytes(c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256))


def _plain(column: pa.Array) -> pa.Array:
    """The texts with punctuation as blanks; the byte lengths stay."""
    data, offsets = tv.utf8(column)
    changed = np.frombuffer(_PARTED, np.uint8)[data]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(changed.tobytes()))


@dataclass
class Link:
    """One category's model: sorted feature hashes, their weights, weights of the earlier probabilities, bias."""

    hashes: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass
class Chain:
    categories: list[str]
    links: list[Link] = field(default_factory=list)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[at[1:]] - total[at[:-1]]


def link_scores(link: Link, flat: np.ndarray, at: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    if len(link.hashes):
        i = np.minimum(np.searchsorted(link.hashes, flat), len(link.hashes) - 1)
        w = np.where(link.hashes[i] == flat, link.weights[i], 0.0)
    else:
        w = np.zeros(len(flat))
    return _sigmoid(_sums(w, at) + (earlier - 0.5) @ link.earlier + link.bias)


@dataclass
class Sample:
    """Documents as rows of feature numbers: one entry for each feature of a document that enough documents hold."""

    hashes: np.ndarray
    owner: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Sample:
        flat, at = _flat(sets)
        owner = np.repeat(np.arange(len(sets)), np.diff(at))
        hashes, number, df = np.unique(flat, return_inverse=True, return_counts=True)
        place = np.where(df >= LEAST_DOCUMENTS, np.cumsum(df >= LEAST_DOCUMENTS) - 1, -1)[number] if len(flat) else number
        return cls(hashes[df >= LEAST_DOCUMENTS], owner[place >= 0], place[place >= 0])

    def scores(self, link: Link, earlier: np.ndarray) -> np.ndarray:
        """link_scores of all documents; a link's features are all among the sample's."""
        weights = np.zeros(len(self.hashes))
        weights[np.searchsorted(self.hashes, link.hashes)] = link.weights
        return _sigmoid(np.bincount(self.owner, weights[self.number], len(earlier)) + (earlier - 0.5) @ link.earlier + link.bias)


def _least(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], p: np.ndarray) -> np.ndarray:
    """Where a convex function (value and slopes) is least, by limited-memory quasi-Newton steps, halved until it falls."""
    value, slope = loss(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(slope).max() < FLAT:
            break
        way, shares = slope.copy(), []
        for moved, bent in reversed(past):
            shares.append(moved @ way / (moved @ bent))
            way -= shares[-1] * bent
        if past:
            way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (moved, bent), was in zip(past, reversed(shares), strict=True):
            way += moved * (was - bent @ way / (moved @ bent))
        step, fall = 1.0, slope @ way
        there, down = loss(p - way)
        while there > value - 1e-4 * step * fall and step > 1e-9:
            step /= 2
            there, down = loss(p - step * way)
        moved, bent = -step * way, down - slope
        if moved @ bent > 0:
            past = [*past[1 - MEMORY :], (moved, bent)]
        p, value, slope = p + moved, there, down
    return p


def fit_link(sample: Sample, chosen: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Link:
    """Logistic regression over the documents ``chosen`` (bool) and the features whose rates differ, each scaled by its log
    rate ratio. Earlier probabilities are scaled by theirs as well."""
    n1, n0 = float((y[chosen] == 1).sum()), float((y[chosen] == 0).sum())
    rate = float(np.clip(n1 / max(n1 + n0, 1), 1e-3, 1 - 1e-3)) if n1 + n0 else 0.5
    start = Link(np.zeros(0, np.uint64), np.zeros(0), np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))))
    if not n1 or not n0 or not len(sample.hashes):
        return start
    mine = chosen[sample.owner]
    owner, number = sample.owner[mine], sample.number[mine]
    df = np.bincount(number, minlength=len(sample.hashes))
    hit = np.bincount(number, y[owner], len(sample.hashes))
    ratio = np.log((hit + 0.5) / (n1 + 1)) - np.log((df - hit + 0.5) / (n0 + 1))
    mean = df / (n1 + n0)
    error = np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / n1 + 1 / n0))
    keep = np.flatnonzero((df >= LEAST_DOCUMENTS) & (np.abs(hit / n1 - (df - hit) / n0) >= CERTAIN * error))
    place = np.full(len(sample.hashes), -1)
    place[keep] = np.arange(len(keep))
    col = place[number]
    owner, col = owner[col >= 0], col[col >= 0]
    rows = np.cumsum(chosen) - 1
    owner, earlier, y = rows[owner], earlier[chosen], y[chosen]
    lift = np.log((y @ earlier + 0.5) / (n1 + 1)) - np.log(((1 - y) @ earlier + 0.5) / (n0 + 1))
    earlier = (earlier - 0.5) * lift
    ratio, share, n = ratio[keep], np.where(y == 1, 0.5 / n1, 0.5 / n0), len(keep)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, e, b = p[:n], p[n:-1], p[-1]
        z = np.bincount(owner, (w * ratio)[col], len(y)) + earlier @ e + b
        off = (_sigmoid(z) - y) * share
        value = share @ (np.logaddexp(0, z) - y * z) + RIDGE / 2 * (p[:-1] @ p[:-1])
        return float(value), np.concatenate((np.bincount(col, off[owner], n) * ratio + RIDGE * w, earlier.T @ off + RIDGE * e, [off.sum()]))

    p = _least(loss, np.zeros(n + earlier.shape[1] + 1))
    return Link(sample.hashes[keep], p[:n] * ratio, p[n:-1] * lift, float(p[-1]))


def fit_chain(sets: list[np.ndarray], truth: np.ndarray, categories: list[str]) -> Chain:
    """truth: 0 or 1 by document and category. Folds go by position."""
    model, sample = Chain(categories), Sample.of(sets)
    fold = np.arange(len(sets)) % FOLDS
    seen = np.zeros((len(sets), 0))
    for k in range(len(categories)):
        y = truth[:, k].astype(float)
        out = np.zeros(len(sets))
        if k + 1 < len(categories):
            for f in range(FOLDS):
                here = fold == f
                out[here] = sample.scores(fit_link(sample, ~here, seen, y), seen)[here]
        model.links.append(fit_link(sample, np.ones(len(sets), bool), seen, y))
        seen = np.concatenate([seen, out[:, None]], axis=1)
    return model


def predict(model: Chain, sets: list[np.ndarray]) -> np.ndarray:
    flat, at = _flat(sets)
    seen = np.zeros((len(sets), 0))
    for link in model.links:
        seen = np.concatenate([seen, link_scores(link, flat, at, seen)[:, None]], axis=1)
    return seen


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Chain:
    """Fit on a bounded sample of labelled rows outside the held-out fifth."""
    known = labels.filter((crc_bucket("doc_id", 5) != 0) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    sample = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCUMENTS)
        sample = part if sample is None else sample.union(part)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [s.tobytes() for s in features_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.binary())], ["doc_id", "lang", "y", "features"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    # at most 2 * TRAIN_DOCUMENTS rows: safe to broadcast and to collect
    got = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "lang", "y").mapInArrow(rows, "doc_id long, lang string, y int, features binary").collect()
    got = sorted({(r.doc_id, r.lang, r.y, bytes(r.features)) for r in got}, key=lambda r: (hash_of(r[0]), r))
    common: dict[str, int] = {}
    for _, lang, y, _ in got:
        common[lang] = common.get(lang, 0) + y
    langs = sorted((x for x in common if x and common[x] >= LANGUAGE_DOCUMENTS), key=lambda x: (-common[x], x))
    sets = [np.frombuffer(r[3], np.uint64) for r in got]
    truth = np.array([[*(r[2] and r[1] == x for x in langs), r[2]] for r in got], int).reshape(len(got), len(langs) + 1)
    return fit_chain(sets, truth, [*(f"toxic_{x}" for x in langs), "toxic"])


def hash_of(doc_id: int) -> int:
    return int(tv.mix(np.array([doc_id or 0]).view(np.uint64))[0])


def score_documents(docs: DataFrame, model: Chain) -> DataFrame:
    """doc_id, probabilities by category (map, in chain order) and score (the last one) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            p = predict(shared.value, features_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.tolist(), pa.list_(pa.float64()))], ["doc_id", "p"])

    names = F.array(*map(F.lit, model.categories))
    found = documents(docs).mapInArrow(rows, "doc_id long, p array<double>")
    return found.select("doc_id", F.map_from_arrays(names, "p").alias("categories"), F.element_at("p", -1).alias("score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    toxic = (F.col("score") >= THRESHOLD).cast("int")
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", toxic.alias("predicted"), toxic.alias("toxic"), "categories")
