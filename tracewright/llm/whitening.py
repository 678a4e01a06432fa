"""Whitening of embeddings: principal components of their covariance, scaled to unit variance.

Entries become whole numbers, x = floor(CELLS * entry) + OFFSET. The fit list holds each distinct x once; sums and products
over it are gathered by workers as whole numbers, centred on the floor of the mean before they are multiplied, and what is
left of the mean is taken off exactly. So the covariance does not depend on the order or number of partitions.

The driver holds matrices of dimensions squared only. It brings the covariance to tridiagonal form by Householder
reflections, finds the leading eigenvalues by bisection over Sturm counts, and their vectors by inverse iteration, those of
close eigenvalues being made orthogonal to each other. Workers project every row on the components they got with the task.

Rows whose vector is null, empty, or holds null or non-finite entries are left out; so are those whose length is not the
most common one (the larger of equally common ones), as vectors of different lengths have no common covariance. Entries
beyond what fits a long are cut to its range. Repeated rows and ids stay rows of their own and count once in the fit.
Components of no variance (below LEAST of the whole) are not given, so a table with one distinct vector, or none, gives no
rows. ``deviation`` is null where a long cannot hold it. Components of equal variance come in any rotation. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm.common import shared_folder, table, tidy, written

CELLS, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Share of the whole variance under which a component counts as having none, and rows multiplied at once.
LEAST, ROWS = 1e-12, 4096


class Fit(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # a row each
    trace: float


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflection vectors of a symmetric matrix; vector k acts on rows k + 1 and below."""
    a, d, reflections = matrix.copy(), len(matrix), []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        v[0] += np.copysign(size, v[0])
        size = np.linalg.norm(v)
        reflections.append(v := v / size if size else np.zeros_like(v))
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (p @ v) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * (v @ a[k + 1 :, k]) * v
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eigenvalues of the tridiagonal matrix below each of the given numbers: negative pivots of T - x."""
    small = np.finfo(float).tiny / np.finfo(float).eps
    pivot, count = np.ones(len(at)), np.zeros(len(at), np.int64)
    for k in range(len(diagonal)):
        pivot = diagonal[k] - at - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < small, -small, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling: each is bracketed by Gershgorin's bounds and halved to the last bit."""
    reach = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    edge = np.spacing(max(abs(low[0]), abs(high[0]))) * 2
    low, high, rank = low - edge, high + edge, len(diagonal) - 1 - np.arange(k)
    for _ in range(200):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        below = sturm_counts(diagonal, off, middle) <= rank
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low + (high - low) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """x with (T - shift) x = right, by elimination with row exchanges; vanishing pivots count as ``least``."""
    d = len(diagonal)
    main, upper, second, x = diagonal - shift, np.append(off, 0.0), np.zeros(d), right.copy()
    for k in range(d - 1):
        below = off[k]
        if abs(below) > abs(main[k]):
            factor = main[k] / below
            main[k], upper[k], second[k], main[k + 1], upper[k + 1] = below, main[k + 1], upper[k + 1], upper[k] - factor * main[k + 1], -factor * upper[k + 1]
            x[k], x[k + 1] = x[k + 1], x[k] - factor * x[k + 1]
        else:
            factor = below / (main[k] if abs(main[k]) > least else least)
            main[k + 1] -= factor * upper[k]
            x[k + 1] -= factor * x[k]
    for k in range(d - 1, -1, -1):
        rest = (upper[k] * x[k + 1] if k + 1 < d else 0.0) + (second[k] * x[k + 2] if k + 2 < d else 0.0)
        x[k] = (x[k] - rest) / (main[k] if abs(main[k]) > least else np.copysign(least, main[k]))
    return x


def inverse_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Unit eigenvectors (a row each) of falling eigenvalues; those of a cluster are made orthogonal in every round."""
    size = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    least, made, start, shift = np.finfo(float).eps * size, np.zeros((len(values), len(diagonal))), 0, np.inf
    for i, value in enumerate(values):
        start = i if i and values[i - 1] - value > 1e-3 * size else start
        shift = min(value, shift - 2 * least) if i > start else value  # equal values are taken a little apart
        x = np.random.default_rng(i).standard_normal(len(diagonal))
        for _ in range(rounds):
            x /= np.linalg.norm(x)
            x = _solved(diagonal, off, shift, x, least)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= made[start:i].T @ (made[start:i] @ x)
        made[i] = x / np.linalg.norm(x)
    return made


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to k eigenvalues of a covariance, falling, and their unit vectors (a row each)."""
    size = np.abs(matrix).max(initial=0.0)
    if not size:
        return np.zeros(0), np.zeros((0, len(matrix)))
    diagonal, off, reflections = tridiagonal(matrix / size)
    values = leading_values(diagonal, off, min(k, len(matrix)))
    values = values[values > LEAST * np.trace(matrix) / size]
    vectors = inverse_vectors(diagonal, off, values)
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        vectors[:, k + 1 :] -= 2 * np.outer(vectors[:, k + 1 :] @ v, v)
    return values * size, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cells(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that stay; x is an array of longs."""
    entry = F.col("v").cast("array<double>")
    odd = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # floor cuts to the range of a long; half of it on either side leaves room for the offset
    x = F.transform(entry, lambda c: F.floor(F.greatest(F.least(c * CELLS, F.lit(2.0**61)), F.lit(-(2.0**61)))) + OFFSET)
    rows = embeddings.select("vec_id", F.col(vector).alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~odd)
    return rows.select("vec_id", x.alias("x"))


def common_length(rows: DataFrame) -> int:
    """The most common length of x, the larger of equally common ones; 0 for an empty table."""
    found = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else 0


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most ROWS rows with their x as a matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, part.column(part.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _held(values: np.ndarray) -> np.ndarray:
    """Whole numbers that int64 may not hold once multiplied and summed, as Python's own where that is so."""
    return values if values.size == 0 or float(np.abs(values).max()) ** 2 * len(values) * values.shape[-1] < 2.0**52 else values.astype(object)


def totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and their sums by dimension, exact."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(d, object)
        for batch, x in _matrices(batches, d):
            n, sums = n + len(x), sums + _held(x).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(s) for s in (n, *sums)])], ["place", "part"])

    parts = fit.mapInArrow(rows, "place int, part string").groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    found = {r.place: int(r.total) for r in parts.collect()}
    return found.get(-1, 0), [found.get(k, 0) for k in range(d)]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Of the fit list, divisor n, from exact sums of products of centred entries."""
    d, middle = len(sums), np.array([s // n for s in sums], np.int64)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((d, d), object)
        small = np.zeros((d, d))
        for _, x in _matrices(batches, d):
            y = _held(x - middle)
            if y.dtype == object:
                held = held + y.T @ y
            else:
                more = y.astype(float)
                small = small + more.T @ more  # whole numbers below 2 ** 53 are exact
                if small.max() >= 2.0**51:
                    held, small = held + small.astype(np.int64), np.zeros((d, d))
        held = held + small.astype(np.int64)
        for k in range(d):
            yield pa.RecordBatch.from_arrays([pa.array([k] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([str(v) for v in held[k]])], ["i", "j", "part"])

    parts = fit.mapInArrow(rows, "i int, j int, part string").groupBy("i", "j").agg(F.sum(F.col("part").cast("decimal(38,0)")).cast("string").alias("total"))
    left = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]
    out = np.zeros((d, d))
    for r in parts.collect():
        # one division of whole numbers, rounded once
        out[r.i, r.j] = (n * int(r.total) - left[r.i] * left[r.j]) / (n * n)
    return out


def projected(x: np.ndarray, fit: Fit) -> np.ndarray:
    """Whitened coordinates of rows of x: centred, then projected, then scaled."""
    middle = np.array([s // fit.n for s in fit.sums], np.int64)
    rest = np.array([(s % fit.n) / fit.n for s in fit.sums])
    return ((x - middle) - rest) @ (fit.vectors / np.sqrt(fit.values)[:, None]).T


def identity_error(fit_list: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the covariance of the fit list's whitened rows, minus the identity."""
    d, k = len(fit.sums), len(fit.values)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for _, x in _matrices(batches, d):
            w = projected(x, fit)
            sums, products = sums + w.sum(0), products + w.T @ w
        flat = np.concatenate([sums, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["place", "part"])

    parts = fit_list.mapInArrow(rows, "place int, part double").groupBy("place").agg(F.sum("part").alias("total")).collect()
    flat = np.zeros(k + k * k)
    for r in parts:
        flat[r.place] = r.total
    mean, products = flat[:k] / fit.n, flat[k:].reshape(k, k) / fit.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def fitted(fit_list: DataFrame, d: int, components: int = COMPONENTS) -> Fit:
    n, sums = totals(fit_list, d)
    if not n:
        return Fit(0, sums, np.zeros(0), np.zeros((0, d)), 0.0)
    matrix = covariance(fit_list, n, sums)
    values, vectors = leading_components(matrix, components)
    return Fit(n, sums, values, vectors, float(np.trace(matrix)))


def whitened(rows: DataFrame, fit: Fit) -> DataFrame:
    """(vec_id, deviation, coordinates) of each row of (vec_id, x)."""
    d, n = len(fit.sums), fit.n
    middle, left = (np.array(v, np.int64) for v in ([s // n for s in fit.sums], [s % n for s in fit.sums]))

    @tidy
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, d):
            y = x - middle
            steps = y.astype(object) * n - left if float(np.abs(y).max(initial=0) + 1) ** 2 * n * n * d >= 2.0**62 else y * n - left
            deviation = [int(v) if v < 1 << 63 else None for v in (steps * steps).sum(1)]
            coordinates = projected(x, fit)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(coordinates.ravel()), coordinates.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "coordinates"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(out, "vec_id long, deviation long, coordinates array<double>")


def components_of(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row kept and component."""
    spark = embeddings.sparkSession
    every = cells(embeddings, vector)
    d = common_length(every)
    rows = every.filter(F.size("x") == d)
    fit_list = written(rows.select("x").distinct(), shared_folder(spark, "whitening"))
    fit = fitted(fit_list, d, components) if d else Fit(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    if not len(fit.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(fit_list, fit)
    explained = F.element_at(F.array(*(F.lit(float(v / fit.trace)) for v in fit.values)), F.col("component"))
    placed = whitened(rows, fit).select("vec_id", "deviation", F.posexplode("coordinates").alias("place", "whitened")).withColumn("component", F.col("place") + 1)
    return placed.select("vec_id", "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "embeddings"))
