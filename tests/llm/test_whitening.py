"""Whitening against an eigendecomposition by numpy, and the driver's solver on awkward matrices."""

import math

import numpy as np
import pytest

from tracewright.llm import whitening as wt

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string, `a.b` string, `c``d` string"


def frame(spark, vectors, ids=None):
    rows = [(i, v, 1, "x", "y", "z", "w") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    points = (rng.standard_normal((400, 24)) * np.linspace(2, 0.3, 24)).astype(np.float32).tolist()
    odd = [None, [None] + [0.0] * 23, [math.nan] * 24, [math.inf] + [0.0] * 23, [1.0, 2.0], []]
    return points + points[:30] + odd


def plain(vectors, k):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors if v and len(v) == 24 and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted(set(map(tuple, x))))
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, made = np.linalg.eigh(centred.T @ centred / n)
    values, made = values[::-1], made[:, ::-1]
    return n, [sum((n * c - int(s)) ** 2 for c, s in zip(v, sums, strict=True)) for v in x], (np.array(x) - sums / n) @ made[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_components_by_numpy(spark, vectors):
    n, deviation, want, explained = plain(vectors, 16)
    ids = list(range(len(vectors)))
    rows = wt.components_of(frame(spark, vectors, ids)).collect()
    assert len(rows) == 430 * 16 and {r.n for r in rows} == {n} and n <= 400
    found = np.zeros((430, 16))
    for r in rows:
        found[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    assert np.abs(found * np.sign((found * want).sum(0)) - want).max() < 1e-8
    assert {r.identity_error for r in rows}.pop() < 1e-12


def test_repeats_null_ids_and_partitions(spark, vectors):
    ids = [None, 5, 5] + list(range(3, len(vectors)))
    one, other = (sorted(map(str, wt.components_of(f, 3).drop("identity_error").collect())) for f in (frame(spark, vectors, ids), frame(spark, vectors, ids).repartition(1)))
    assert one == other and len(one) == 430 * 3


@pytest.mark.parametrize("rows", [[], [None], [[1.0, 2.0]] * 5, [[], None]])
def test_nothing_varies(spark, rows):
    assert wt.components_of(frame(spark, rows)).collect() == []


def test_few_rows_and_lengths(spark):
    rows = wt.components_of(frame(spark, [[0.0, 1.0, 2.0], [1.0, 1.0, 2.0], [0.0, 1.0], [2.0, 1.0]])).collect()
    # two of each length: the longer one counts, and two points span one component
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), r.explained) for r in rows) == [(0, 1, 1.0, 1.0), (1, 1, 1.0, 1.0)]


def test_very_large_entries(spark):
    rows = wt.components_of(frame(spark, [[3e38, 0.0], [-3e38, 1.0], [2e7, 2.0], [1.5, -2e7]])).collect()
    # the second component's share of the variance is below LEAST
    assert len(rows) == 4 and {r.deviation for r in rows} == {None} and {r.identity_error for r in rows}.pop() < 1e-4
    rows = wt.components_of(frame(spark, [[2e7, 1.0], [-2e7, 1.0], [1e7, 2.0]])).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in ([2e7, 1.0], [-2e7, 1.0], [1e7, 2.0])]
    want = [sum((3 * v[k] - sum(w[k] for w in x)) ** 2 for k in (0, 1)) for v in x]
    assert {r.vec_id: r.deviation for r in rows} == dict(enumerate(w if w < 1 << 63 else None for w in want))


def rotated(values):
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((len(values), len(values))))[0]
    return q @ np.diag(np.array(values, float)) @ q.T


MATRICES = {
    "one": np.array([[2.0]]),
    "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
    "identity": np.eye(40),
    "blocks": np.diag(np.repeat([5.0, 3.0, 1.0], [10, 10, 20])),
    "clusters": rotated(np.repeat([5.0, 3.0, 1.0], [10, 10, 20])),
    "close": rotated(1 + np.arange(40) * 1e-13),
    "graded": rotated(np.geomspace(1e12, 1e-3, 40)),
    "rank one": np.ones((40, 40)),
    "paired": np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
    "tiny": rotated(np.linspace(1, 2, 40)) * 1e-200,
}


@pytest.mark.parametrize("name", MATRICES)
def test_solver(name):
    m = MATRICES[name]
    values, vectors = wt.leading_components(m, 16)
    want = np.linalg.eigvalsh(m)[::-1][:16]
    want = want[want > wt.LEAST * np.trace(m)]
    assert len(values) == len(want) and np.abs(values - want).max() <= 1e-13 * want[0]
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(m @ vectors.T - vectors.T * values).max() <= 1e-13 * want[0] * len(m)
    assert len(wt.leading_components(np.zeros((3, 3)), 2)[0]) == 0


def test_sturm_counts():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(30), rng.standard_normal(29)
    b[7] = 0
    values = np.linalg.eigvalsh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1))
    at = np.concatenate([(values[1:] + values[:-1]) / 2, [values[0] - 1, values[-1] + 1]])
    assert (wt.sturm_counts(a, b, at) == [(values < x).sum() for x in at]).all()
