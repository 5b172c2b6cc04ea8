"""Singular values and right singular vectors of a square matrix by its bidiagonal form.

Householder reflections from both sides leave a diagonal and one beside it. The squares of the
singular values come from differential quotient-difference sweeps with shifts (dqds), which change
every entry by a few roundings only and keep all of them positive, so small values are as accurate
as large ones. The vector of a value is read off the twisted factorisation of the shifted
tridiagonal matrix that has the smallest pivot at its twist. Values too close for that alone are
taken together: one inverse iteration of their vectors, and the best rotation inside their span.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Neighbours whose gap is smaller than this, relative to the larger, are taken together.
CLOSE = 1e-3


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, right of it, V): the matrix is U B V' with orthogonal U, which is not kept."""
    a = np.array(matrix, float)
    n = len(a)
    v = np.eye(n)

    def reflector(x):
        length = np.linalg.norm(x)
        if not length:
            return None
        u = x.copy()
        u[0] += length if x[0] >= 0 else -length
        return u / np.linalg.norm(u)

    for k in range(n):
        u = reflector(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k + 2 < n:
            u = reflector(a[k, k + 1 :])
            if u is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float):
    """One dqds sweep; None if the shift was more than the smallest value."""
    new_q, new_e, d = [], [], q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        total = d + e[i]
        if total == 0:
            return None
        ratio = q[i + 1] / total
        new_q.append(total)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    return [*new_q, d], new_e


def squared_values(diagonal: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling."""
    out, tolerance = [], (10 * EPS) ** 2
    parts = [((diagonal**2).tolist(), (beside**2).tolist(), 0.0)]
    while parts:
        q, e, base = parts.pop()
        for _ in range(100 * len(q) + 100):
            if len(q) == 1:
                out.append(base + q[0])
                break
            if e[-1] <= tolerance * (base + q[-1]):
                out.append(base + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            cut = [i for i, x in enumerate(e) if x <= tolerance * (base + min(q[i], q[i + 1]))]
            if cut:
                at = cut[-1]
                parts.append((q[: at + 1], e[:at], base))
                q, e = q[at + 1 :], e[at + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            # The smaller value of the last two rows is above the smallest of all.
            half = (q[-2] + e[-1] + q[-1]) / 2
            product = q[-2] * q[-1]
            large = half + max(half * half - product, 0.0) ** 0.5
            tail = product / large if large else 0.0
            for shift in (tail, tail - (e[-1] * q[-1]) ** 0.5, tail / 2, tail / 8, 0.0):
                swept = _sweep(q, e, shift) if 0 <= shift else None
                if swept:
                    q, e = swept
                    base += shift
                    break
            else:
                raise ArithmeticError("no shift was possible")
        else:
            raise ArithmeticError("the sweeps did not converge")
    return np.sort(np.array(out))[::-1]


def twisted_vector(diagonal: np.ndarray, beside: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for one of its eigenvalues, from the twisted factorisation of
    B'B - value with the smallest pivot."""
    n = len(diagonal)
    tiny = EPS * EPS * max(np.abs(diagonal).max(), np.abs(beside).max(initial=0.0), 1e-300)
    a = np.where(np.abs(diagonal) > tiny, diagonal, tiny)
    d, ratio = (a * a).tolist(), (beside / a[:-1]).tolist()
    small = tiny * tiny or 1e-300
    down, s = [0.0] * (n - 1), [-value] * n
    for i in range(n - 1):
        pivot = s[i] + d[i] or small
        down[i] = d[i] * ratio[i] / pivot
        s[i + 1] = down[i] * ratio[i] * s[i] - value
    up, p = [0.0] * (n - 1), [d[-1] - value] * n
    for i in range(n - 2, -1, -1):
        pivot = d[i] * ratio[i] * ratio[i] + p[i + 1] or small
        step = d[i] / pivot
        up[i] = ratio[i] * step
        p[i] = p[i + 1] * step - value
    twist = int(np.argmin([abs(x + y + value) for x, y in zip(s, p, strict=True)]))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -up[i] * z[i]
    if not np.isfinite(z).all():
        return np.eye(n)[twist]
    return z / np.linalg.norm(z)


def _together(tridiagonal: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Orthonormal vectors of values that are close to one another."""
    n, k = vectors.shape
    # Vectors that coincide are told apart by a little of something else.
    start = vectors + 1e-3 * np.random.default_rng(n).standard_normal((n, k)) / np.sqrt(n)
    middle = values.mean() * (1 + 4 * EPS) + np.finfo(float).tiny
    for _ in range(3):
        basis, _ = np.linalg.qr(start)
        try:
            start = np.linalg.solve(tridiagonal - middle * np.eye(n), basis)
        except np.linalg.LinAlgError:
            middle *= 1 + 64 * EPS
    basis, _ = np.linalg.qr(start)
    _, turn = np.linalg.eigh(basis.T @ tridiagonal @ basis)
    return basis @ turn[:, ::-1]


def principal_directions(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of all singular values, falling; right singular vectors of the first k, as columns)."""
    n = len(matrix)
    k = min(k, n)
    diagonal, beside, v = bidiagonal(matrix)
    largest = max(np.abs(diagonal).max(), np.abs(beside).max(initial=0.0))
    cut = np.abs(beside) <= EPS * EPS * largest
    edges = [0, *(np.flatnonzero(cut) + 1), n]
    found = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        d, u = diagonal[a:b], beside[a : b - 1]
        found += [(value, a, b) for value in squared_values(d, u)]
    found.sort(key=lambda x: (-x[0], x[1]))
    out = np.zeros((n, k))
    # A group reaches past the k-th value as far as values are close.
    for a, b in {(a, b) for _, a, b in found[:k]}:
        d, u = diagonal[a:b], beside[a : b - 1]
        places = [i for i, x in enumerate(found) if x[1] == a]
        values = np.array([found[i][0] for i in places])
        groups = np.split(np.arange(len(values)), np.flatnonzero(values[:-1] - values[1:] > CLOSE * values[:-1]) + 1)
        for group in groups:
            if places[group[0]] >= k:
                continue
            vectors = np.column_stack([twisted_vector(d, u, values[i]) for i in group])
            if len(group) > 1:
                whole = np.diag(d) + np.diag(u, 1)
                vectors = _together(whole.T @ whole, values[group], vectors)
            for i, z in zip(group, vectors.T, strict=True):
                if places[i] < k:
                    out[a:b, places[i]] = z
    return np.array([x[0] for x in found]), v @ out
