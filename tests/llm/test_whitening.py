"""Whitening against a dense eigendecomposition of exact sums."""
from fractions import Fraction

import numpy as np
import pytest

from llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, _x string, _id int, n int, component string"


def rows_of(matrix, start=0):
    return [(start + i, [float(v) for v in row], 1, "x", 3, 4, "c") for i, row in enumerate(matrix)]


def dense(vectors, components=16):
    x = [[int(np.floor(64.0 * np.float32(v))) + 1_000_000 for v in row] for row in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]

    def centred(rows):
        return np.array([[float(Fraction(v * n - s, n)) for v, s in zip(r, sums)] for r in rows])
    c = centred(fit)
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum())) if e[0] > 0 else 0
    deviation = [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x]
    return n, e[:k], e[:k] / e.sum(), centred(x) @ q[:, :k] / np.sqrt(e[:k]), deviation


def compare(got, vectors, components=16, near=1e-9):
    n, e, share, white, deviation = dense(vectors, components)
    assert len(got) == white.size
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    for i, expected in enumerate(white):
        assert sorted(by[i]) == list(range(1, len(e) + 1))
        for c, r in by[i].items():
            assert r["n"] == n and r["deviation"] == deviation[i] and r["identity_error"] <= 1e-9
            assert r["explained"] == pytest.approx(share[c - 1], rel=1e-9)
    for c in range(len(e)):
        column = np.array([by[i][c + 1]["whitened"] for i in range(len(white))])
        assert min(np.abs(column - white[:, c]).max(), np.abs(column + white[:, c]).max()) < near


@pytest.mark.parametrize("shape,components", [((300, 24), 16), ((300, 5), 16), ((40, 20), 3)])
def test_random(spark, shape, components):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=shape) @ rng.normal(size=(shape[1], shape[1]))).astype(np.float32)
    vectors = np.concatenate([vectors, vectors[:30], np.repeat(vectors[:1], 200, 0)])  # copies count once in the fit
    got = W.whiten(spark.createDataFrame(rows_of(vectors), SCHEMA), components)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), vectors, components)


def test_low_rank_and_few_rows(spark):
    """Dimensions that repeat each other give fewer components, and so do fewer rows than dimensions."""
    rng = np.random.default_rng(2)
    base = rng.integers(-9, 9, (200, 3))
    compare(W.whiten(spark.createDataFrame(rows_of(np.c_[base, base, base[:, :1]]), SCHEMA)).collect(), np.c_[base, base, base[:, :1]])
    few = rng.normal(size=(5, 12)).astype(np.float32)
    got = W.whiten(spark.createDataFrame(rows_of(few), SCHEMA)).collect()
    compare(got, few)
    assert {r["component"] for r in got} == {1, 2, 3, 4}


def test_equal_eigenvalues(spark):
    """A chain from one vector sees an eigenvalue once; the others come from new vectors."""
    cube = np.array([[a, b, c, d] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1) for d in (-1, 1)], np.float32)
    got = W.whiten(spark.createDataFrame(rows_of(cube), SCHEMA)).collect()
    assert {(r["component"], round(r["explained"], 12), r["identity_error"] < 1e-12) for r in got} == {(c, .25, True) for c in (1, 2, 3, 4)}


def test_odd_rows(spark):
    good = np.array([[1, 2], [3, 5], [-4, 0.5], [3, 5]], np.float32)
    odd = [(50, None), (51, [1.0, None]), (52, [float("nan"), 1.0]), (53, [float("inf"), 1.0]), (54, []), (55, [1.0]), (None, [7.0, 7.0])]
    rows = [*rows_of(good), *[(i, v, None, "x", 3, 4, "c") for i, v in odd]]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2, 3, None} and len(got) == 10 and {r["n"] for r in got} == {4}
    assert W.whiten(spark.createDataFrame(rows[:1] * 3, SCHEMA)).collect() == []
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert W.whiten(spark.createDataFrame(rows[4:10], SCHEMA)).collect() == []


def test_large_entries(spark):
    """Sums of squares are exact beyond the range of doubles, and null beyond that of a long."""
    vectors = np.array([[2e6, 1], [-2e6, 3], [1e6, -5]], np.float32)
    compare(W.whiten(spark.createDataFrame(rows_of(vectors), SCHEMA)).collect(), vectors, near=1e-8)
    huge = np.array([[1e30, 0], [-1e30, 1], [0, 5]], np.float32)
    assert {r["deviation"] for r in W.whiten(spark.createDataFrame(rows_of(huge), SCHEMA)).collect()} >= {None}


def test_bidiagonal_form(spark):
    """X V = U B with orthonormal V, left vectors included, and fewer steps where they suffice."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 40)) * np.r_[np.full(2, 50.0), np.full(38, 1e-1)]
    whole = W.whole_vectors(spark.createDataFrame(rows_of(vectors), SCHEMA), "vec_id", "embedding", 64, 0)
    model = W.fit_whitening(whole, 2)
    assert model.steps < 40 and model.identity_error < 1e-10
    x = np.array([r["_x"] for r in whole.collect()], float)
    x -= x.mean(0)
    blocks = W.row_blocks(whole.select("_x").distinct(), 40)
    v, b, energy = W.bidiagonalise(W.Rows(blocks, model.n, model.sums), 40, 2, -1)
    u = np.linalg.solve(b.T, (x @ v).T).T
    assert v.shape == (40, 40) and np.abs(v.T @ v - np.eye(40)).max() < 1e-12 and np.abs(u.T @ u - np.eye(40)).max() < 1e-9
    assert np.abs(b - np.triu(np.tril(b, 1))).max() == 0 and energy == pytest.approx((x ** 2).sum())


def test_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    from llm.queries import QUERIES
    got = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").collect()
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    compare([{**r.asDict(), "vec_id": place[r["vec_id"]]} for r in got], [r["embedding"] for r in rows])
