"""The bidiagonal solver against numpy, whitening against eigenvectors of the covariance."""

import math

import numpy as np
import pytest

from reportloom.llm import whitening
from reportloom.llm.bidiagonal import bidiagonalise, leading, squared_singular_values

SCHEMA = "vec_id bigint, embedding array<float>, x string, component string, n string"


def matrices():
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    return {
        "random": rng.standard_normal((40, 40)), "one": rng.standard_normal((1, 1)), "two": rng.standard_normal((2, 2)),
        "triangle": np.linalg.qr(rng.standard_normal((3000, 32)))[1], "identity": np.eye(9), "zero": np.zeros((6, 6)),
        "rank one": np.outer(rng.standard_normal(12), rng.standard_normal(12)), "zeros inside": np.diag([0.0, 2, 0, 1, 0, 3]),
        "five equal": np.diag([3.0] * 5 + [1.0] * 25) @ turn, "graded": np.diag(10.0 ** -np.arange(30)) @ turn,
        "nearly equal": np.diag(1 + 1e-10 * np.arange(30)) @ turn, "tiny": 1e-120 * rng.standard_normal((7, 7)),
    }


@pytest.mark.parametrize("name", list(matrices()))
def test_leading_singular_vectors(name):
    a = matrices()[name]
    values, vectors = leading(a, 4)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    top = max(float(want[0]), 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * top and vectors.shape == (len(a), min(4, len(a)))
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-11
    assert np.abs(a.T @ (a @ vectors) - vectors * values[: vectors.shape[1]]).max() <= 1e-12 * top


def test_small_values_keep_their_digits():
    diagonal, beside = 10.0 ** -np.arange(12.0), 10.0 ** -np.arange(12.0)[:-1] / 3
    values = np.sqrt(squared_singular_values(diagonal, beside))
    assert math.isclose(float(np.prod(values)), float(np.prod(diagonal)), rel_tol=1e-12)


def test_bidiagonal_form():
    a = np.random.default_rng(2).standard_normal((8, 8))
    diagonal, beside, right = bidiagonalise(a)
    b = np.diag(diagonal) + np.diag(beside, 1)
    assert len(right) == 6 and np.allclose(np.linalg.svd(b, compute_uv=False), np.linalg.svd(a, compute_uv=False))


def plain(rows, k, scale=256):
    """Exact columns by id, whitened columns up to sign, shares and number of distinct vectors."""
    fit = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(scale * float(np.float32(c))) for c in v] for _, v in fit])
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(distinct.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    z = (x - sums / n) @ v[:, :k] / np.sqrt(e[:k])
    return [i for i, _ in fit], n, ((n * x - sums) ** 2).sum(axis=1), z, e[:k] / e.sum()


def vectors(seed=7, count=300, dims=9):
    rng = np.random.default_rng(seed)
    data = rng.standard_normal((count, dims)) @ np.diag(np.linspace(2, 0.3, dims))
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(count + i, rows[3][1]) for i in range(200)] + [(3, rows[3][1]), (None, rows[5][1])]
    odd = [None, [None] * dims, [math.nan] * dims, [math.inf] * dims, [-math.inf] + [0.0] * (dims - 1), [], [1.0] * (dims + 1)]
    return rows, rows + [(1000 + i, v) for i, v in enumerate(odd)]


def test_whitening_matches_eigenvectors(spark):
    rows, given = vectors()
    table = spark.createDataFrame([(i, v, "x", "x", "x") for i, v in given], SCHEMA).repartition(40)
    got = whitening.whiten(table).toPandas().sort_values(["vec_id", "whitened"], na_position="first", kind="stable")
    ids, n, deviation, z, share = plain(rows, 4)
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-10
    order = sorted(range(len(ids)), key=lambda j: (ids[j] is not None, ids[j] or 0))
    for c in range(4):
        own = got[got["component"] == c + 1]
        assert (own["deviation"].to_numpy() == deviation[order]).all()
        have, want = own["whitened"].to_numpy(), z[order, c]
        sign = math.copysign(1.0, float(have @ want))
        assert np.abs(have * sign - want).max() < 1e-9 and abs(own["explained"].iloc[0] - share[c]) < 1e-12


def test_few_dimensions_and_no_variance(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], SCHEMA)).collect()

    assert run([]) == [] and run([(1, None), (2, []), (3, [math.nan])]) == []
    same = run([(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert len(same) == 4
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, None, None)}
    line = run([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [-0.0, 0.0])])
    assert len(line) == 6 and {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True}
    assert {abs(round(r["whitened"], 9)) for r in line if r["component"] == 1} == {1.0}
    assert {r["component"]: round(r["explained"], 9) for r in line} == {1: 1.0, 2: 0.0}


def test_values_of_any_size(spark):
    rows = [(i, [float(np.float32(3e38)) if i == 0 else float(i), 1e15 * i, -float(i * i)]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 3).collect()
    assert len(got) == 27 and all(r["deviation"] is None for r in got if r["vec_id"] == 0)
    exact = whitening.whiten(spark.createDataFrame(rows[1:], "vec_id bigint, embedding array<double>"), 3).collect()
    x = [[math.floor(256 * c) for c in v] for _, v in rows[1:]]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((8 * c - s) ** 2 for c, s in zip(v, sums)) for (i, _), v in zip(rows[1:], x)}
    assert {r["vec_id"]: r["deviation"] for r in exact} == {i: d if d < 1 << 63 else None for i, d in want.items()}


def test_other_names(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 0.5]), ("c", [0.0, 0.0])], "key string, v array<double>")
    got = whitening.whiten(rows, 1, id_col="key", vector_col="v")
    assert got.columns[0] == "key" and sorted(r["key"] for r in got.collect()) == ["a", "b", "c"]
