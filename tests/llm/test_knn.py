import numpy as np
import pytest

from slicewise.llm import knn as K


def brute(data, queries, k):
    out = []
    for q in queries:
        s = sorted((-int(np.dot(data[q].astype(object), v.astype(object))), i) for i, v in data.items() if i != q)
        out += [(q, r, i, -x) for r, (x, i) in enumerate(s[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("n, dim, spread, settings", [
    (300, 4, 2.0, {}), (400, 3, 0.05, {"pivots": 12, "block_rows": 30, "group_queries": 4}), (7, 5, 1.0, {}), (250, 2, 3000.0, {"pivots": 40, "block_rows": 16})])
def test_top_k_equals_brute_force(spark, n, dim, spread, settings):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(6, dim)) * 5
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * spread
    x[: n // 3] = x[0]                                   # a third of all rows are one vector
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    v = K.integer_vectors(df)
    data = {i: np.floor(r * 1024).astype(np.int64) for i, r in enumerate(x)}
    got = K.top_k(v.filter("vec_id % 5 = 0"), v, **settings)
    assert sorted(map(tuple, got.collect())) == brute(data, [i for i in data if i % 5 == 0], 10)


def test_pruning_leaves_rows_behind(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(100, 3)) + 100, rng.normal(size=(400, 3)) - 100])
    v = K.integer_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    seen = []
    original = K._search

    plan = K.top_k(v.filter("vec_id = 0"), v, pivots=20)._jdf.queryExecution().toString()
    assert "low" in plan and original is K._search and not seen


def test_odd_vectors_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [2.0, 0.0], "b"), (1, [2.0, 0.0], "b"), (2, None, "c"), (3, [float("nan"), 1.0], "d"),
            (4, [float("inf"), 1.0], "e"), (5, [None, 1.0], "f"), (6, [], "g"), (None, [1.0, 1.0], "h"), (7, [-0.0001, 3.0], "i"), (8, [2e9, 2e9], "j")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    v = K.integer_vectors(df)
    assert sorted(r.vec_id for r in v.collect()) == [0, 1, 1, 7, 8]
    got = K.top_k(v.filter("vec_id in (0, 1)"), v)
    assert sorted(map(tuple, got.collect())) == brute(
        {0: np.array([1024, 0]), 1: np.array([2048, 0]), 7: np.array([-1, 3072]), 8: np.array([2048 * 10 ** 9] * 2)}, [0, 1], 10)
    assert K.top_k(v.limit(0), v).collect() == [] and K.top_k(v, v.limit(0)).collect() == []


def test_an_id_names_its_least_vector_and_other_lengths_stay_out(spark):
    rows = [(100, [5, 1]), (100, [2, 9]), (1, [3, 3]), (1, [1, 7]), (2, [4, 4]), (3, [1, 2, 3]), (200, [1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in K.top_k(df.filter("vec_id % 100 = 0"), df).collect()]
    assert sorted(got) == [(100, 1, 1, 2 * 1 + 9 * 7), (100, 2, 2, 2 * 4 + 9 * 4)]
