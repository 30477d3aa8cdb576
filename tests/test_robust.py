"""Small systems in expressions and Huber fits."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from slicewise.operators import robust as R


def test_elimination_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for k in range(6):
        a = rng.normal(size=(9, 4))
        m, b = a.T @ a, rng.normal(size=4)
        rows.append((k, np.column_stack([m, b]).tolist()))
        want.append(np.linalg.solve(m, b))
    df = spark.createDataFrame(rows, "k int, m array<array<double>>")
    got = {r.k: r.w for r in df.select("k", R.solve_system(F.col("m"), 4).alias("w")).collect()}
    for k, w in enumerate(want):
        np.testing.assert_allclose(got[k], w, rtol=1e-9)


def test_dependent_column_gets_zero(spark):
    m = [[2.0, 2.0, 0.0, 4.0], [2.0, 2.0, 0.0, 4.0], [0.0, 0.0, 0.0, 0.0]]
    df = spark.createDataFrame([(m,)], "m array<array<double>>")
    assert df.select(R.solve_system(F.col("m"), 3).alias("w")).first().w == [2.0, 0.0, 0.0]


def test_huber_is_the_optimum_of_its_loss(spark):
    rng = np.random.default_rng(3)
    n = 300
    pdf = pd.DataFrame({"slice": rng.choice(["u", "v"], n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf["y"] = pdf["a"] - 0.5 * pdf["b"] + rng.standard_t(1.5, size=n)
    pdf["x"] = 3.0
    fits = {r["slice"]: r for r in R.huber_fit(spark.createDataFrame(pdf).repartition(3), ["a", "b"], ["y", "x"], ["slice"]).collect()}
    for s, g in pdf.groupby("slice"):
        x = np.column_stack([g[["a", "b"]], np.ones(len(g))])
        assert fits[s].n == len(g) and fits[s].gradient < 1e-8
        for k, t in enumerate(("y", "x")):
            w = np.array(fits[s].w[k])
            slope = x.T @ np.clip(g[t] - x @ w, -1, 1) / len(g) - R.RIDGE * np.append(w[:2], 0)
            assert np.abs(slope).max() < 1e-7


def test_huber_of_nothing(spark):
    none = spark.createDataFrame([], "slice string, a double, y double")
    assert R.huber_fit(none, ["a"], ["y"], ["slice"]).collect() == []
