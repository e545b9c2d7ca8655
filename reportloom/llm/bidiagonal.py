"""Singular values and right singular vectors of a small square matrix by way of its bidiagonal form.

Householder reflections make the matrix bidiagonal, the dqds iteration finds all singular values, and a twisted
factorisation of the shifted tridiagonal product gives the vector of each wanted one (Fernando and Parlett 1994;
Dhillon and Parlett 2004).
"""

from __future__ import annotations

import math

import numpy as np

_EPS = float(np.finfo(float).eps)
_CLOSE = 1e-3  # eigenvalues nearer than this share of the largest are made orthogonal to each other


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and the right reflectors of U' matrix V; reflector j acts on the columns after j."""
    a = np.array(matrix, dtype=float)
    n = a.shape[0]
    right: list[np.ndarray] = []
    for j in range(n):
        v = _reflector(a[j:, j])
        a[j:, j:] -= np.outer(v, 2.0 * (v @ a[j:, j:]))
        if j < n - 2:
            w = _reflector(a[j, j + 1 :])
            a[j:, j + 1 :] -= np.outer(2.0 * (a[j:, j + 1 :] @ w), w)
            right.append(w)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit vector v such that x - 2 v (v . x) is a multiple of the first axis; zero where nothing is to reflect."""
    v = x.copy()
    top = np.abs(v).max(initial=0.0)
    if top == 0.0 or not np.any(v[1:]):
        return np.zeros_like(v)
    v /= top
    v[0] += math.copysign(float(np.linalg.norm(v)), v[0])
    return v / np.linalg.norm(v)


def squared_singular_values(diagonal: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Squares of all singular values of an upper bidiagonal matrix, falling, by dqds with deflation and splitting."""
    found: list[float] = []
    blocks = [([float(x) * float(x) for x in diagonal], [float(x) * float(x) for x in beside], 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        stuck = 0
        while q:
            n = len(q)
            if n == 1:
                found.append(moved + q[0])
                break
            split = next((i for i in range(n - 2, -1, -1) if e[i] <= (_EPS / 4) ** 2 * (moved + q[i])
                          or e[i] <= _EPS * _EPS * (moved + q[i + 1]) or e[i] < 1e-300), None)
            if split == n - 2:
                found.append(moved + q.pop())
                e.pop()
                continue
            if split is not None:
                blocks.append((q[: split + 1], e[:split], moved))
                q, e = q[split + 1 :], e[split + 1 :]
                continue
            if n == 2:
                found += [moved + x for x in _pair(q[0], e[0], q[1])]
                break
            if q[0] < q[-1] * 0.66:  # the small end belongs at the end
                q.reverse()
                e.reverse()
            shift = _pair(q[-2], e[-1], q[-1])[1] * (1.0 - 4 * _EPS) if stuck < 60 else 0.0
            for attempt in range(5):
                shift = 0.0 if attempt == 4 else shift
                done = _step(q, e, shift)
                if done is not None:
                    break
                shift *= 0.75 if attempt == 0 else 0.25
            q, e = done
            moved += shift
            stuck += 1
            if stuck > 200 * (n + 10):
                raise ArithmeticError("dqds does not converge")
    return np.array(sorted(found, reverse=True))


def _pair(a: float, b: float, c: float) -> tuple[float, float]:
    """Larger and smaller squared singular value of the bidiagonal matrix with squares a, b above c."""
    total, product = a + b + c, a * c
    root = math.sqrt(max(0.0, (total - 2 * math.sqrt(product)) * (total + 2 * math.sqrt(product))))
    large = (total + root) / 2
    return large, product / large if large > 0.0 else 0.0


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None where the shift is beyond the smallest eigenvalue."""
    d = q[0] - shift
    new_q, new_e = [], []
    for i in range(len(e)):
        if d < 0.0:
            return None
        top = d + e[i]
        new_q.append(top)
        if top == 0.0:
            new_e.append(0.0)
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / top
            new_e.append(e[i] * ratio)
            d = d * ratio - shift
    if d < 0.0:
        return None
    new_q.append(d)
    return new_q, new_e


class _Twisted:
    """Twisted factorisation of T - value * I, for the symmetric tridiagonal T with the given diagonals."""

    def __init__(self, main: np.ndarray, off: np.ndarray, value: float) -> None:
        n = len(main)
        least = _EPS * _EPS * max(float(np.abs(main).max()), 1e-250)
        moved, self.off = main - value, off
        self.down, self.up = moved.copy(), moved.copy()
        for i in range(n):
            if i:
                self.down[i] -= off[i - 1] * off[i - 1] / self.down[i - 1]
            self.down[i] = self.down[i] if abs(self.down[i]) > least else least
        for i in range(n - 1, -1, -1):
            if i < n - 1:
                self.up[i] -= off[i] * off[i] / self.up[i + 1]
            self.up[i] = self.up[i] if abs(self.up[i]) > least else least
        joint = self.down + self.up - moved
        self.twist = int(np.abs(joint).argmin())
        self.middle = joint[self.twist] if abs(joint[self.twist]) > least else least

    def solve(self, right: np.ndarray | None) -> np.ndarray:
        """Solution of the factored system, or without ``right`` of the one whose only entry is the middle pivot."""
        n, r, off = len(self.down), self.twist, self.off
        y = np.zeros(n) if right is None else right.copy()
        for i in range(1, r + 1):
            y[i] -= off[i - 1] / self.down[i - 1] * y[i - 1]
        for i in range(n - 2, r - 1, -1):
            y[i] -= off[i] / self.up[i + 1] * y[i + 1]
        x = np.zeros(n)
        x[r] = 1.0 if right is None else y[r] / self.middle
        for i in range(r - 1, -1, -1):
            x[i] = (y[i] - off[i] * x[i + 1]) / self.down[i]
        for i in range(r + 1, n):
            x[i] = (y[i] - off[i - 1] * x[i - 1]) / self.up[i]
        return x


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values, falling, and the right singular vectors of the first ``k`` as columns.

    Vectors of close values are made orthogonal in two more solves each. The entry of a vector with the largest size is
    positive.
    """
    n = matrix.shape[0]
    unit = math.ldexp(1.0, math.frexp(float(np.abs(matrix).max(initial=0.0)))[1])  # squares neither vanish nor overflow
    diagonal, beside, right = bidiagonalise(matrix / unit)
    values = squared_singular_values(diagonal, beside)
    main = diagonal * diagonal
    main[1:] += beside * beside
    off = diagonal[:-1] * beside
    columns: list[np.ndarray] = []
    for j in range(min(k, n)):
        close = [columns[i] for i in range(j) if values[i] - values[j] <= _CLOSE * values[0]]
        twisted = _Twisted(main, off, float(values[j]))
        z = _unit(twisted.solve(None))
        if close or not np.isfinite(z).all():
            z = np.random.default_rng(j).standard_normal(n)
            for _ in range(4):
                z = _unit(_apart(twisted.solve(_apart(z, close)), close))
        columns.append(_unit(_apart(z, close)))
    vectors = np.array(columns).T.reshape(n, -1)
    for j in range(len(right) - 1, -1, -1):
        w = right[j]
        vectors[j + 1 :] -= np.outer(2.0 * w, w @ vectors[j + 1 :])
    for j in range(vectors.shape[1]):
        if vectors[np.abs(vectors[:, j]).argmax(), j] < 0.0:
            vectors[:, j] *= -1.0
    return values * unit * unit, vectors


def _apart(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            z = z - other * (other @ z)
    return z


def _unit(z: np.ndarray) -> np.ndarray:
    top = np.abs(z).max(initial=0.0)
    return z / top / np.linalg.norm(z / top) if top > 0.0 and np.isfinite(top) else z
