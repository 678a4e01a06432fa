"""Threshold-scaled sketches of documents.

A sketch holds every 5-word shingle hash (64 bits, uniform) below a fixed fraction of the hash range. Sketches of parts
merge by union, and the share of one sketch found in another estimates containment however unequal the sizes are.
A text whose shingles all miss the fraction keeps its smallest hash, so only texts without words have empty sketches; a
merge drops such hashes again where another part has some below the fraction.

One hash in SCALE is kept: a document of 50 words has about a dozen, enough to tell a third's edit from another text, while
a sketch stays a third of its text's size. For large documents alone a smaller fraction does.

Order of documents: doc_id descending, nulls last, repeated ids by text; equal rows follow each other and are equally like.
Null texts count as empty, texts of any length are read whole, and an empty table gives no rows; a single document is its
own next one. Extra columns do not matter, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm import textvec as tv
from tracewright.llm.common import documents, small_batches, table, tidy

#: One shingle hash in so many is kept, and a shingle has so many words.
SCALE, WORDS = 4, 5


def limit(scale: int) -> np.uint64:
    """The largest hash that a sketch keeps."""
    return np.uint64(((1 << 64) - 1) // scale)


def sketches(texts: pa.Array, scale: int = SCALE, n: int = WORDS) -> list[np.ndarray]:
    """The sketch of each text: sorted distinct hashes below 2**64 / scale."""
    h, at = tv.shingles(*tv.words(*tv.utf8(texts)), n)
    low = h <= limit(scale)
    kept = np.concatenate(([0], np.cumsum(low)))[at]
    few = h[low]
    out = []
    for i, (a, b) in enumerate(zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)):
        if a < b:
            out.append(np.unique(few[a:b]))
        else:
            whole = h[at[i] : at[i + 1]]
            out.append(whole.min(keepdims=True) if len(whole) else whole)
    return out


def merge(*parts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of texts together, up to shingles that cross their borders. The hash that stands for a part without any
    below the fraction stays only while no part has one below it."""
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))
    low = every[every <= limit(scale)]
    return low if len(low) else every[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 1 for two empty sketches, 0 if one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller sketch in the larger one."""
    return containment(a, b) if len(a) <= len(b) else containment(b, a)


def text_form(sketch: np.ndarray) -> str:
    """The top 48 bits of each hash, in order, in base 64 (8 characters a hash)."""
    return base64.b64encode((sketch >> np.uint64(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id, hashes (array of long) and text form for each document."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = sketches(batch.column(1), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array(map(text_form, found), pa.string())], ["doc_id", "hashes", "fingerprint"])

    return documents(docs).mapInArrow(rows, "doc_id long, hashes array<long>, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt so that each group ``part`` holds a run of the descending order followed by a guest: the first row of
    the next run (after the last run, the first one's). Sorted within partitions by part, guest, and the order.

    Only run borders and one id a run reach the driver.
    """
    spark = docs.sparkSession
    docs = documents(docs)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)})
    run = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(F.lit(borders) if borders else F.array().cast("array<long>"), lambda b: b <= F.col("doc_id"))))
    docs = docs.withColumn("part", run)
    first = sorted(docs.groupBy("part").agg(F.max("doc_id")).collect(), key=lambda r: -r[0])
    guests: dict[int, int] = {}
    null_to = None
    for i, (part, _) in enumerate(first):
        nxt = first[(i + 1) % len(first)]
        if nxt[1] is None:
            null_to = part
        else:
            guests[nxt[1]] = part
    to = F.lit(None).cast("int")
    if guests:
        to = F.create_map(*[F.lit(x).cast("long" if k == 0 else "int") for g in guests.items() for k, x in enumerate(g)])[F.col("doc_id")]
    if null_to is not None:
        to = F.when(F.col("doc_id").isNull(), F.lit(null_to)).otherwise(to)
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    guest = F.struct(to.alias("part"), F.lit(True).alias("guest"))
    dealt = docs.select("doc_id", "text", F.explode(F.filter(F.array(own, guest), lambda x: x.part.isNotNull())).alias("at"))
    return dealt.select("doc_id", "text", "at.part", "at.guest").repartition("part").sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    """The last third (rounded down) of the code points replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def neighbours(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each document and of its edited text, with their likeness and the one to the next document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in small_batches(batches):
            ids, texts, part, guest = (c.to_pylist() for c in batch.columns)
            if held:
                ids, texts, part, guest = ([h, *x] for h, x in zip(held, (ids, texts, part, guest), strict=True))
            if ids:
                held = ids[-1], texts[-1], part[-1], guest[-1]
            own = [i for i in range(len(ids) - 1) if not guest[i]]
            if not own:
                continue
            changed = [edited(texts[i], texts[i + 1]) for i in own]
            plain = sketches(pa.array(texts, pa.large_string()), scale)
            altered = sketches(pa.array(changed, pa.large_string()), scale)
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array(sha, pa.string()),
                    pa.array([text_form(plain[i]) for i in own], pa.string()),
                    pa.array(map(text_form, altered), pa.string()),
                    pa.array([likeness(plain[i], e) for i, e in zip(own, altered, strict=True)], pa.float64()),
                    pa.array([likeness(plain[i], plain[i + 1]) for i in own], pa.float64()),
                ],
                names,
            )

    return with_next(docs).mapInArrow(rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents"))
