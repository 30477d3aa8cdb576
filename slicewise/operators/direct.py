"""Direct multi-step forecaster: all horizons of all targets from one history, by least squares.

A window's 60 rows are summed up as spans: each of the newest rows by itself, older ones as means of
a period. One linear map per slice takes these numbers of the three targets to 15 x 3 future
values. It is fitted from sums of products (Gram matrix and cross products), which a task forms for a
piece of a series with array arithmetic; no window ever becomes a row, and what is shuffled is a
matrix per piece. The system of a slice is small and has one right-hand side per output.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.functions import scalars as S
from slicewise.operators import allocate as A
from slicewise.operators.features import TARGETS
from slicewise.operators.joins import join_groups

#: Spans of rows before the forecast, newest first: (distance of the newest, of the oldest row).
SPANS = [(k, k) for k in range(1, 16)] + [(16, 30), (31, 45), (46, dims.HISTORY)]
#: Weight of the penalty on squared coefficients of standardised inputs, per window.
RIDGE = 1e-3
#: Rows of a series that one task takes at a time (about).
PIECE = 1 << 14
INPUTS = len(SPANS) * len(TARGETS) + 1           # with the constant
OUTPUTS = dims.HORIZON * len(TARGETS)
Z = [f"z_{t}" for t in TARGETS]


def scales(train: DataFrame) -> DataFrame:
    """Per slice the ``scale`` of the targets, an array of (mean, std). A constant target gets spread 1."""
    return train.groupBy("slice").agg(F.array(*[F.struct(
        F.avg(t).alias("mean"), F.when(F.stddev_pop(t) > 1e-12, F.stddev_pop(t)).otherwise(1.0).alias("std"))
        for t in TARGETS]).alias("scale"))


def scaled(rows: DataFrame, scale: DataFrame) -> DataFrame:
    """Adds the standardised targets ``z_<target>``."""
    z = {f"z_{t}": (F.col(t) - F.col("scale")[k]["mean"]) / F.col("scale")[k]["std"] for k, t in enumerate(TARGETS)}
    return join_groups(rows, scale, ["slice"]).withColumns(z).drop("scale")


def _windows(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and outputs of every window of consecutive rows ``z`` (rows x targets)."""
    whole = np.lib.stride_tricks.sliding_window_view(z, dims.HISTORY + dims.HORIZON, axis=0)
    past, future = whole[:, :, :dims.HISTORY], whole[:, :, dims.HISTORY:]
    spans = [past[:, :, dims.HISTORY - old:dims.HISTORY - new + 1].mean(2) for new, old in SPANS]
    x = np.stack(spans, 2).reshape(len(whole), -1)
    return np.column_stack([x, np.ones(len(x))]), future.reshape(len(whole), -1)


def window_sums(series: DataFrame, keys: list[str], piece: int = PIECE) -> DataFrame:
    """``slice, i, j, v``: sums over the training windows of products of input i with input j, or with
    output j - INPUTS. ``series`` carries ``pos`` from 0 without gaps, ``cut`` (rows of a series before
    it are for training) and the standardised targets. Series without a whole window add nothing.

    A training window starts before cut - 75, as in the temporal split. A piece sees the rows of a
    window that reach into the next one."""
    reach = dims.HISTORY + dims.HORIZON
    rows = series.filter(F.col("pos") < F.col("cut") - 1)
    pieces = F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - reach + 1) / piece)), F.floor(F.col("pos") / piece))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        z = g.sort_values("pos")[Z].to_numpy(float)[:piece + reach - 1]
        if len(z) < reach:
            return pd.DataFrame(columns=["slice", "i", "j", "v"]).astype({"i": np.int32, "j": np.int32, "v": float})
        x, y = _windows(z)
        m = x.T @ np.column_stack([x, y])
        i, j = np.indices(m.shape)
        return pd.DataFrame({"slice": g["slice"].iloc[0], "i": i.ravel(), "j": j.ravel(), "v": m.ravel()})

    # a piece's first row is one at which windows start: rows before it belong to earlier pieces
    parts = rows.select(*keys, "pos", *Z, F.explode(pieces).alias("piece"))
    return (parts.groupBy(*keys, "piece").applyInPandas(run, "slice string, i int, j int, v double")
            .groupBy("slice", "i", "j").agg(F.sum("v").alias("v")))


def solve_all(sums: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """``slice, n_windows, w, gradient``: the coefficients (one array of INPUTS numbers per output) of
    least squares with penalty n * ridge on all but the constant, and the largest entry of the
    gradient per window, which is zero at the optimum. One matrix of fixed size per slice."""
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((INPUTS, INPUTS + OUTPUTS))
        m[g["i"], g["j"]] = g["v"]
        n = m[INPUTS - 1, INPUTS - 1]
        gram, cross = m[:, :INPUTS], m[:, INPUTS:]
        penal = np.diag(np.append(np.full(INPUTS - 1, ridge * n), 0.0))
        w = np.linalg.solve(gram + penal, cross)
        worst = np.abs((gram + penal) @ w - cross).max() / n
        return pd.DataFrame({"slice": [key[0]], "n_windows": [int(round(n))], "w": [[list(c) for c in w.T]],
                             "gradient": [worst]})

    return sums.groupBy("slice").applyInPandas(
        run, "slice string, n_windows bigint, w array<array<double>>, gradient double")


def history() -> list[Column]:
    """Aggregates of a window's rows (``h`` below 0: history) that give its inputs: ``x``."""
    mean = lambda t, new, old: F.avg(F.when(F.col("h").between(-old, -new), F.col(f"z_{t}")))
    return [F.array(*[mean(t, new, old) for t in TARGETS for new, old in SPANS], F.lit(1.0)).alias("x")]


def forecast(windows: DataFrame, fits: DataFrame) -> DataFrame:
    """Adds ``steps`` to windows with inputs ``x``: an array of the 15 steps with h, thr, lat_log, loss and
    lat (ms). ``fits`` has ``w`` and ``scale`` by slice; windows of a slice without a fit are left out."""
    j = join_groups(windows, fits.select("slice", "w", "scale"), ["slice"])
    dot = F.transform("w", lambda c: F.aggregate(F.zip_with(c, F.col("x"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    value = lambda out, k, t: (F.get(out, F.lit(k * dims.HORIZON) + t) * F.col("scale")[k]["std"]
                               + F.col("scale")[k]["mean"])
    steps = lambda out: F.transform(F.sequence(F.lit(0), F.lit(dims.HORIZON - 1)), lambda t: F.struct(
        t.alias("h"), *[value(out, k, t).alias(name) for k, name in enumerate(TARGETS)]))
    out = j.withColumn("_out", dot).withColumn("steps", steps(F.col("_out"))).drop("_out", "w", "scale")
    return out.withColumn("steps", F.transform("steps", lambda s: s.withField("lat", F.expm1(s["lat_log"]))))


def late_share(limit: Column) -> Column:
    return F.size(F.filter("steps", lambda s: s["lat"] > limit)) / dims.HORIZON


def direct_loads(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted late share and load per (window, slice) from the forecast ``steps``."""
    f = A.with_facts(windows).withColumn("p_pred", late_share(F.col("control_lat_max")))
    mean = F.aggregate("steps", F.lit(0.0), lambda s, x: s + x["thr"]) / dims.HORIZON
    rho = S.predicted_load(F.col("p_pred"), mean, F.col("capacity"), F.col("curve_k"), F.col("curve_rho"))
    return f.select(*keys, "t", F.round(rho, 9).alias("rho"), "p_pred", "p_real")
