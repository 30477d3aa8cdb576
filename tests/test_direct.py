"""Direct multi-step forecaster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.operators import direct as D
from slicewise.operators.features import TARGETS

KEYS = ["scenario", "gnb", "slice"]


def made(seed=3):
    """Three series of two slices: smooth, noisy, and one too short for a window."""
    rng = np.random.default_rng(seed)
    out = []
    for scenario, gnb, slice_, n in (("a", "Macro", "eMBB", 400), ("b", "Macro", "eMBB", 290), ("a", "Macro", "URLLC", 333),
                                     ("c", "Macro", "URLLC", 74)):
        z = np.cumsum(rng.normal(size=(n, 3)), 0) * 0.1 + np.sin(np.arange(n) / 9)[:, None]
        out.append((scenario, gnb, slice_, int(n * 0.8), z))
    return out


def frame(spark, series):
    rows = [(s, g, sl, i, cut, *map(float, r)) for s, g, sl, cut, z in series for i, r in enumerate(z)]
    return spark.createDataFrame(rows, "scenario string, gnb string, slice string, pos long, cut long, "
                                       + ", ".join(f"{c} double" for c in D.Z))


def plain_windows(z, first, last):
    """Inputs and outputs of the windows that start in first .. last - 1."""
    x, y = [], []
    for s in range(first, last):
        past, future = z[s:s + 60], z[s + 60:s + 75]
        x.append([past[60 - old:61 - new, k].mean() for k in range(3) for new, old in D.SPANS] + [1.0])
        y.append(future.T.ravel())
    return np.array(x).reshape(-1, D.INPUTS), np.array(y).reshape(-1, D.OUTPUTS)


@pytest.mark.parametrize("piece", [1 << 14, 50, 7])
def test_sums_and_fit_equal_plain_windows(spark, piece):
    series = made()
    sums = D.window_sums(frame(spark, series), KEYS, piece)
    got = {r["slice"]: r for r in D.solve_all(sums).collect()}
    for slice_ in ("eMBB", "URLLC"):
        parts = [plain_windows(z, 0, cut - 75) for _, _, sl, cut, z in series if sl == slice_]
        x, y = (np.concatenate(p) for p in zip(*parts))
        penal = np.diag([D.RIDGE * len(x)] * (D.INPUTS - 1) + [0])
        want = np.linalg.solve(x.T @ x + penal, x.T @ y)
        assert got[slice_].n_windows == len(x)
        assert np.allclose(np.array(got[slice_].w).T, want, atol=1e-7) and got[slice_].gradient < 1e-9


def test_no_training_window_no_fit(spark):
    assert D.window_sums(frame(spark, [s for s in made() if len(s[4]) == 74]), KEYS).collect() == []
    assert D.window_sums(frame(spark, []), KEYS).collect() == []


def test_forecast_of_a_window(spark):
    series = made()
    fits = D.solve_all(D.window_sums(frame(spark, series), KEYS)).withColumn("scale", F.expr(
        "array(named_struct('mean', 2D, 'std', 3D), named_struct('mean', 0D, 'std', 1D), named_struct('mean', 5D, 'std', 2D))"))
    z = series[0][4]
    t = 350
    rows = frame(spark, series[:1]).filter((F.col("pos") >= t - 60) & (F.col("pos") < t + 15)).withColumn("h", F.col("pos") - t)
    windows = rows.groupBy(*KEYS).agg(*D.history())
    got = D.forecast(windows, fits).first()["steps"]
    x, _ = plain_windows(z, t - 60, t - 59)
    w = np.array(next(r.w for r in fits.collect() if r["slice"] == "eMBB"))
    out = (x @ w.T).reshape(3, 15)
    for h in range(15):
        assert got[h].h == h
        assert np.isclose(got[h].thr, out[0, h] * 3 + 2) and np.isclose(got[h].loss, out[2, h] * 2 + 5)
        assert np.isclose(got[h].lat, np.expm1(out[1, h]))


def test_spans_cover_the_history_once():
    assert sorted(k for a, b in D.SPANS for k in range(a, b + 1)) == list(range(1, dims.HISTORY + 1))
    assert D.INPUTS == len(TARGETS) * 18 + 1 and D.OUTPUTS == 45


def test_constant_target_has_spread_one(spark):
    rows = spark.createDataFrame([("eMBB", 1.0, 2.0, 0.0), ("eMBB", 3.0, 2.0, 0.0)], "slice string, thr double, lat_log double, loss double")
    z = D.scaled(rows, D.scales(rows)).collect()
    assert sorted((r.z_thr, r.z_lat_log, r.z_loss) for r in z) == [(-1.0, 0.0, 0.0), (1.0, 0.0, 0.0)]
