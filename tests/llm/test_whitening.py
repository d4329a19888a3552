"""Whitening against numpy, and the eigensolver on operators larger than its search space."""

from __future__ import annotations

import math

import numpy as np
import pytest

from duskline.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n long, x string, dim int"


def frame(spark, vectors):
    rows = [(i, None if v is None else [None if e is None else float(e) for e in v], 1, 2, "x", 3) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def check(rows, vectors, k):
    """All columns against numpy, for usable vectors (id, v)."""
    x = np.floor(64 * np.array([v for _, v in vectors], float)).astype(np.int64) + 1000000
    n = len(x)
    c = x - x.mean(axis=0)
    values = np.linalg.eigvalsh(c.T @ c / n)[::-1]
    sums = [int(s) for s in x.sum(axis=0)]
    deviation = {i: sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for (i, _), row in zip(vectors, x)}
    assert len(rows) == n * k and {r.component for r in rows} == set(range(1, k + 1))
    assert all(r.n == n and r.deviation == deviation[r.vec_id] == int(r.deviation_exact) for r in rows)
    assert all(abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-10 for r in rows)
    w = np.zeros((n, k))
    place = {i: p for p, (i, _) in enumerate(vectors)}
    for r in rows:
        w[place[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-8 and all(r.identity_error < 1e-8 for r in rows)
    # each component is V's eigenvector: the rows' coordinates are c u / sqrt(e)
    u = np.linalg.lstsq(c, w * np.sqrt(values[:k]), rcond=None)[0]
    assert np.abs(c.T @ (c @ u) / n - u * values[:k]).max() < 1e-9 * values[0]


def test_whitening(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, v) for i, v in enumerate(rng.normal(size=(300, 40)) * np.linspace(3, 0.5, 40) + 5)]
    vectors += [(i + 1000, v) for i, v in vectors[:9]]
    bad = [(2000, None), (2001, [math.nan] * 40), (2002, [math.inf] + [0.0] * 39), (2003, [None] + [1.0] * 39), (2004, [])]
    rows = whitening.whiten(frame(spark, vectors + bad)).collect()
    check(rows, vectors, 32)


def test_fewer_dimensions_and_other_lengths(spark):
    rng = np.random.default_rng(2)
    five = [(i, v) for i, v in enumerate(rng.normal(size=(50, 5)))]
    three = [(100 + i, v) for i, v in enumerate(rng.normal(size=(20, 3)))]
    rows = whitening.whiten(frame(spark, five + three)).collect()
    check([r for r in rows if r.vec_id < 100], five, 5)
    check([r for r in rows if r.vec_id >= 100], three, 3)


def test_flat_lists_give_no_components(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(6)]
    rows = whitening.whiten(frame(spark, line)).collect()
    assert {r.component for r in rows} == {1} and abs(rows[0].explained - 1) < 1e-12


def test_huge_entries_stay_exact(spark):
    vectors = [(None if i == 3 else i, [1e9 * i, -3e8 * (i % 3), 5.0]) for i in range(8)] + [(90, [1e300, 0.0, 0.0])]
    rows = whitening.whiten(frame(spark, vectors[:-1])).collect()
    x = [[math.floor(64 * e) + 1000000 for e in v] for _, v in vectors[:-1]]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((8 * a - s) ** 2 for a, s in zip(row, sums)) for (i, _), row in zip(vectors, x)}
    assert {r.vec_id: int(r.deviation_exact) for r in rows} == want
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in rows)
    assert whitening.whiten(frame(spark, vectors)).count() > 0


@pytest.mark.parametrize("gap", ["plain", "clustered", "equal"])
def test_jacobi_davidson_restarts_and_locks(gap):
    rng = np.random.default_rng(3)
    dim, k = 300, 12
    values = {"plain": np.linspace(10, 0.1, dim), "clustered": np.r_[10 + 1e-4 * np.arange(8), np.linspace(5, 0, dim - 8)],
              "equal": np.r_[np.full(5, 9.0), np.full(5, 8.0), np.linspace(7, 0, dim - 10)]}[gap]
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    v = turn * values @ turn.T
    calls = []

    def product(u):
        calls.append(u.shape[1])
        return v @ u

    got, vectors = whitening.jacobi_davidson(product, dim, k)
    assert np.abs(got - np.sort(values)[::-1][:k]).max() < 1e-11
    assert np.linalg.norm(v @ vectors - vectors * got, axis=0).max() < 1e-12 * 10
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert max(calls) <= k + 4


def test_minres():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    b = rng.normal(size=(30, 3))
    b[:, 2] = 0
    x = whitening.minres(lambda u: a @ u, b, 60, 1e-12)
    assert np.abs(a @ x - b).max() < 1e-8
