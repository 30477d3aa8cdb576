import math

import numpy as np
import pytest

from slicewise.llm import whitening as W

SHAPE = "vec_id long, embedding array<float>"


def plain(x):
    """Covariance, eigenvalues and eigenvectors by numpy from exactly centred rows."""
    n = len(x)
    s = x.astype(object).sum(0)
    d = x.astype(object) * n - s
    c = d.astype(float) / n
    value, axis = np.linalg.eigh(c.T @ c / n)
    return d, c, value[::-1], axis[:, ::-1]


def made(n, d, seed=1, condition=1e3):
    rng = np.random.default_rng(seed)
    mix = np.linalg.qr(rng.normal(size=(d, d)))[0] * np.geomspace(1, 1 / condition, d)
    return (rng.normal(size=(n, d)) @ mix.T + rng.normal(size=d)).astype(np.float32)


@pytest.mark.parametrize("n,d", [(300, 16), (40, 3), (5, 12)])
def test_whole_output_equals_numpy(spark, n, d):
    v = made(n, d)
    x = np.floor(v.astype(float) * 1024).astype(np.int64) + 100000
    dev, c, value, axis = plain(x)
    k = min(8, d, n - 1)
    rows = W.whiten(W.integer_rows(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], SHAPE).repartition(3))).collect()
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, j) for i in range(n) for j in range(1, k + 1)]
    got = np.zeros((n, k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and int(r.deviation) == sum(int(q) ** 2 for q in dev[r.vec_id])
        assert math.isclose(r.explained, value[r.component - 1] / value.sum(), rel_tol=1e-9)
        assert 0 <= r.identity_error < 1e-9
    want = c @ axis[:, :k] / np.sqrt(value[:k])
    for j in range(k):
        assert min(np.abs(got[:, j] - want[:, j]).max(), np.abs(got[:, j] + want[:, j]).max()) < 1e-6
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9


def test_triangular_solve_and_factor():
    rng = np.random.default_rng(2)
    r = np.triu(rng.normal(size=(7, 7))) + np.eye(7) * 5
    rows = rng.normal(size=(20, 7))
    assert np.allclose(W.back_solve(rows, r) @ r, rows)
    g = rows.T @ rows
    assert np.allclose(W.factor(g, 20, False).T @ W.factor(g, 20, False), g)
    flat = np.ones((3, 3))
    assert W.factor(flat - 1e-9 * np.eye(3), 3, False) is None and W.factor(flat, 3, True) is not None


def test_wide_range_of_variances_and_missing_directions(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(-10 ** 9, 10 ** 9, 200), rng.integers(-2, 3, 200), np.full(200, 7), np.zeros(200, int)])
    x[:, 3] = x[:, 0] * 2                                        # two of the four directions carry nothing
    w = W.fit(spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(2))
    _, c, value, _ = plain(x)
    assert len(w.eigenvalues) == 2
    small = np.linalg.svd(c, compute_uv=False)[:2] ** 2 / 200    # not from the squared matrix
    assert np.allclose(w.eigenvalues, small, rtol=1e-6) and math.isclose(w.trace, value.sum(), rel_tol=1e-12)
    y = w.apply(x, 2)
    assert np.abs(y.T @ y / 200 - np.eye(2)).max() < 1e-6


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (2, None, "a"), (3, [1.0, None], "a"), (4, [nan, 1.0], "a"), (5, [inf, 1.0], "a"),
            (6, [], "a"), (7, [1.0, 2.0, 3.0], "a"), (8, [3e38, 1.0], "a"), (9, [-0.0001, 0.5], "a"), (1, [1.0, 2.0], "a"),
            (None, [2.0, -1.0], "b")]
    df = spark.createDataFrame(rows, SHAPE + ", component string")
    x = W.integer_rows(df)
    assert x.filter("vec_id = 9").first().x == [99999, 100512]
    got = W.whiten(x).collect()
    assert sorted((r.vec_id or -1, r.component) for r in got) == sorted([(i, k) for i in (1, 1, 9, -1) for k in (1, 2)])
    assert {r.n for r in got} == {4}
    huge = spark.createDataFrame([(1, [1e15, 0.0]), (2, [0.0, 1e15]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    big = {r.vec_id: r.deviation for r in W.whiten(W.integer_rows(huge)).collect()}
    a = 1024 * 10 ** 15
    want = [(3 * a - a - 1024, -a - 1024), (-a - 1024, 3 * a - a - 1024), (3 * 1024 - a - 1024, 3 * 1024 - a - 1024)]
    assert [int(big[i]) for i in (1, 2, 3)] == [p * p + q * q for p, q in want]


def test_nothing_to_whiten(spark):
    assert W.whiten(W.integer_rows(spark.createDataFrame([], SHAPE))).collect() == []
    assert W.whiten(W.integer_rows(spark.createDataFrame([(1, [0.5])], SHAPE))).collect() == []
    same = spark.createDataFrame([(i, [0.25, -0.25]) for i in range(5)], SHAPE)
    assert W.whiten(W.integer_rows(same)).collect() == []
