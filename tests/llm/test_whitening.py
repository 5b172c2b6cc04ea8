from __future__ import annotations

import math

import numpy as np
import pytest

from driftmark.llm import bidiagonal, whitening
from driftmark.sources.scratch import materialize

SCHEMA = "vec_id long, embedding array<double>, n string, length string, x string, component string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def reference(vectors):
    """Distinct whole vectors, covariance and its eigenvectors, all in one go."""
    whole = [tuple(math.floor(256 * x) for x in v) for v in vectors]
    fit_list = np.array(sorted(set(whole)), float)
    mean = fit_list.mean(0)
    centred = fit_list - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit_list))
    return whole, len(fit_list), mean, values[::-1], vectors[:, ::-1]


def check(rows, got, k=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole, n, mean, values, vectors = reference([v for _, v in kept])
    totals = [sum(c) for c in zip(*sorted(set(whole)), strict=True)]
    k = min(k, len(totals))
    assert len(got) == k * len(kept)
    want = {}
    for (i, _), x in zip(kept, whole, strict=True):
        exact = sum((n * a - s) ** 2 for a, s in zip(x, totals, strict=True))
        scores = (np.array(x) - mean) @ vectors[:, :k]
        want.setdefault(i, []).append((exact, scores))
    signs = {}
    for r in got:
        assert r.n == n
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9, abs=1e-12)
        assert r.identity_error < 1e-9
        choices = [s[r.component - 1] for d, s in want[r.vec_id] if d == r.deviation]
        assert choices
        if len(choices) == 1 and values[r.component - 1] > 1e-9 * values[0]:
            score = choices[0] / math.sqrt(values[r.component - 1])
            assert abs(abs(r.whitened) - abs(score)) < 1e-7 * (1 + abs(score))
            if abs(score) > 1e-6:
                signs.setdefault(r.component, set()).add(r.whitened * score > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_against_one_covariance(spark):
    rng = np.random.default_rng(4)
    spread = np.diag([3, 2, 1, 0.5, 0.3, 0.1]) @ np.linalg.qr(rng.standard_normal((6, 6)))[0]
    rows = [(i, list(map(float, v))) for i, v in enumerate(rng.standard_normal((500, 6)) @ spread)]
    # Copies count once in the fit; repeated and null ids are rows like any other.
    rows += [(1000 + i, v) for i, (_, v) in enumerate(rows[:150])] + [(None, rows[3][1]), (1, rows[9][1])]
    bad = [(-1, None), (-2, [math.nan] + [0.0] * 5), (-3, [None] * 6), (-4, [math.inf] * 6)]
    got = whitening.whiten(table(spark, rows + bad), components=6 * 50).collect()
    check(rows + bad, got)


def test_lengths_are_whitened_apart(spark):
    rng = np.random.default_rng(5)
    short = [(i, list(map(float, v))) for i, v in enumerate(rng.standard_normal((40, 2)))]
    long = [(100 + i, list(map(float, v))) for i, v in enumerate(rng.standard_normal((60, 5)))]
    got = whitening.whiten(table(spark, [*short, *long, (500, [])])).collect()
    check(short, [r for r in got if r.vec_id < 100])
    check(long, [r for r in got if r.vec_id >= 100])


def test_without_variance(spark):
    got = whitening.whiten(table(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, 0.0, 0.0)] * 4
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)]
    got = whitening.whiten(table(spark, line)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert {r.component: r.explained for r in got} == pytest.approx({1: 1.0, 2: 0.0, 3: 0.0})
    assert whitening.whiten(table(spark, [])).count() == 0


def test_many_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rng = np.random.default_rng(6)
    points = {n: rng.integers(-500, 500, (200, n)) for n in (2, 3)}
    rows = [(i, list(map(int, v))) for p in points.values() for i, v in enumerate(p)]
    vectors = spark.createDataFrame(rows, "vec_id long, x array<long>").repartition(23)
    # A task holds vectors of both lengths, so there are about 46 triangles to begin with.
    fit_list = materialize(whitening.packed(vectors, components=30), "fit-list")
    found = whitening.triangles(fit_list, materialize(whitening.sums(fit_list), "sums")).collect()
    assert sorted(r.length for r in found) == [2, 3]
    for row in found:
        r = np.array(row.r).reshape(row.length, -1)
        centred = points[row.length] - points[row.length].mean(0)
        assert np.allclose(r.T @ r, centred.T @ centred, rtol=1e-10)


def test_deviations_beyond_a_long():
    points = np.array([[0, 0], [1 << 20, 0], [3, -4]])
    totals = np.array([0, 0])
    got = whitening._deviations(points, 1 << 12, totals).to_pylist()
    assert got == [0, None, 25 << 24]


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_singular_values_and_vectors(n):
    a = np.random.default_rng(n).standard_normal((n, n))
    squares, v = bidiagonal.principal_directions(a, n)
    assert np.allclose(squares, np.linalg.svd(a)[1] ** 2, rtol=1e-10)
    assert np.allclose(v.T @ v, np.eye(n), atol=1e-10)
    assert np.allclose(a.T @ a @ v, v * squares, atol=1e-11 * squares[0])


def test_repeated_close_and_graded_values():
    rng = np.random.default_rng(8)
    q, p = (np.linalg.qr(rng.standard_normal((20, 20)))[0] for _ in range(2))
    for first in ([5, 5, 5, 3], [5, 5 - 1e-9, 5 - 1e-12, 3], [1, 1, 1, 1]):
        values = np.array(first + [1.0] * 16)
        a = q @ np.diag(values) @ p
        squares, v = bidiagonal.principal_directions(a, 4)
        assert np.allclose(squares, values**2, rtol=1e-12)
        assert np.allclose(v.T @ v, np.eye(4), atol=1e-12)
        assert np.allclose(a.T @ a @ v, v * squares[:4], atol=1e-12 * squares[0])
    # Small values keep their digits: the determinant is the product of the diagonal.
    diagonal, beside = 10.0 ** -np.arange(10), 0.5 * 10.0 ** -np.arange(9)
    squares = bidiagonal.squared_values(diagonal, beside)
    assert np.prod(np.sqrt(squares)) == pytest.approx(np.prod(diagonal), rel=1e-13)
    zero, v = bidiagonal.principal_directions(np.zeros((3, 3)), 2)
    assert (zero == 0).all() and np.allclose(v.T @ v, np.eye(2))
