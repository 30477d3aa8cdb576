"""Closed loop over all evaluation windows at once: forecast, load, allocation, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.functions import scalars as S
from slicewise.operators import allocate as A
from slicewise.operators import forecast as FC
from slicewise.operators.features import base_features
from slicewise.operators.joins import join_groups
from slicewise.operators.series import over_frames
from slicewise.operators.windows import aligned_cells, series_lengths, with_eval_windows

SERIES = ["scenario", "gnb", "slice"]


def eval_rows(series: DataFrame, kpi: DataFrame | None = None) -> DataFrame:
    """Rows of all evaluation windows with the late flag under the relaxed detection limit.
    ``series`` carries positions; the lengths are counted on ``kpi``, the same rows without
    positions, where that is at hand."""
    s = base_features(series)
    lim = dims.limit_dim(s.sparkSession, "detect").select("slice", F.col("lat_max").alias("_m"))
    lengths = series_lengths(s if kpi is None else kpi, SERIES)
    rows = with_eval_windows(s, aligned_cells(lengths)).join(lim, "slice")
    late = F.col("lat") > S.relaxed_latency_limit(F.col("slice"), F.col("_m"))
    return rows.withColumn("late", late.cast("double")).drop("_m")


def forecast_loads(fits: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """Predicted late share and load per (window, slice)."""
    f = A.with_facts(fits, curves)
    f = f.withColumn("p_pred", FC.late_share(F.col("control_lat_max")))
    rho = S.predicted_load(F.col("p_pred"), FC.mean_over_steps("thr"), F.col("capacity"),
                           F.col("curve_k"), F.col("curve_rho"))
    return f.select(*SERIES, "t", F.round(rho, 9).alias("rho"), "p_pred", "p_real",
                    FC.mean_latency_ahead().alias("lat_pred"))


PERIOD = dims.HORIZON
NEAR = 64           # periods in a bucket of the join by time


def online_windows(rows: DataFrame) -> DataFrame:
    """Fits of the evaluation windows with what the online learner sees of each: means of the
    newest period of the history (log latency, tenth of the throughput), and the period in
    which the window starts."""
    newest = F.col("h").between(-PERIOD, -1)
    return FC.window_fits(rows, SERIES, (
        F.round(F.avg(F.when(newest, F.col("lat_log"))), 9).alias("x_lat"),
        (F.round(F.avg(F.when(newest, F.col("thr"))), 9) / 10).alias("x_thr"),
        F.floor(F.max(F.when(F.col("h") == 0, F.col("tick"))) / PERIOD).cast("bigint").alias("starts")))


def with_last_step(windows: DataFrame, steps: DataFrame) -> DataFrame:
    """Each window with the newest learning step of its series that ended before it starts
    (``step``, ``loss``, ``w``, ``fedavg``; step 0 and zero weights if there is none yet).

    A step holds from the period after its own to the period of the next step. Steps and windows
    meet in buckets of periods, so neither a series' steps nor its windows are gathered."""
    last = windows.groupBy(*SERIES).agg(F.max("starts").alias("_end"))
    held = over_frames(steps.select(*SERIES, "period", "step", "loss", "w", "fedavg"), SERIES, "step",
                       lambda w: {"_next": F.lead("period").over(w)}, after=1)
    held = join_groups(held, last, SERIES).withColumn("_next", F.coalesce("_next", "_end"))
    bucket = lambda c: F.floor(c / NEAR)
    held = (held.filter(F.col("_next") > F.col("period"))
            .withColumn("_b", F.explode(F.sequence(bucket(F.col("period") + 1), bucket(F.col("_next")))))
            .drop("_end"))
    on = [*SERIES, "_b"]
    met = (windows.withColumn("_b", bucket(F.col("starts"))).alias("a").join(held.alias("b"), [
        *[F.col(f"a.{k}") == F.col(f"b.{k}") for k in on], F.col("b.period") < F.col("a.starts"),
        F.col("a.starts") <= F.col("b._next")], "left"))
    none = F.array(*[F.lit(0.0)] * 3)
    return met.select("a.*", F.coalesce("b.step", F.lit(0)).cast("bigint").alias("step"), F.col("b.loss").alias("loss"),
                      F.coalesce("b.w", none).alias("w"), F.coalesce("b.fedavg", F.lit(False)).alias("fedavg")).drop("_b")


def online_loads(windows: DataFrame) -> DataFrame:
    """Predicted late share and load from the weights each window was given."""
    f = A.with_facts(windows)
    w = F.col("w")
    lat = F.expm1(w[0] + w[1] * F.col("x_lat") + w[2] * F.col("x_thr"))
    f = f.withColumn("p_pred", (lat > F.col("control_lat_max")).cast("double"))
    rho = S.predicted_load(F.col("p_pred"), FC.mean_over_steps("thr"), F.col("capacity"),
                           F.col("curve_k"), F.col("curve_rho"))
    return f.select(*SERIES, "t", F.round(rho, 9).alias("rho"), "p_pred", "p_real", "step", "loss", "fedavg")


def run_online_loop(loads: DataFrame) -> DataFrame:
    """The loop with the learner's state: newest step of the cell's slices, their mean training
    loss, and whether a slice's weights come straight from an averaging over the cells."""
    state = loads.groupBy("scenario", "gnb", "t").agg(
        F.max("step").alias("step"), F.round(F.avg("loss"), 6).alias("train_loss"),
        F.bool_or("fedavg").alias("fedavg"))
    return run_loop(loads.drop("step", "loss", "fedavg")).join(state, ["scenario", "gnb", "t"])


def run_loop(loads: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """One row per (scenario, cell, window): objective, gain, loads, predicted, observed and
    estimated late shares, chosen units."""
    keys = ["scenario", "t"]
    p = A.choose_three(A.problems(loads, keys, curves, extra=("p_pred", "p_real")))
    f_def = A.default_objective(F.col("slices"))
    p = p.withColumns({"_d": f_def, "_o": F.col("best.total")})
    cols: list[Column] = [F.round("_d", 4).alias("F_default"),
                          F.round("_o", 4).alias("F_optimal"),
                          S.gain_pct(F.col("_d"), F.col("_o")).alias("gain_pct")]
    errors = []
    for i, s in enumerate(dims.SLICES):
        item = F.col("slices")[i]
        units = F.col("best.units")[i]
        after = S.logistic(item["rho"] * item["units_default"] / F.greatest(units, F.lit(1)),
                           item["curve_k"], item["curve_rho"])
        cols += [F.round(item["rho"], 4).alias(f"rho_{s}"),
                 F.round(item["p_pred"], 4).alias(f"p_pred_{s}"),
                 F.round(item["p_real"], 4).alias(f"p_real_{s}"),
                 F.round(after, 4).alias(f"p_sla_opt_{s}"),
                 units.cast("bigint").alias(f"R_{s}_opt")]
        errors.append(F.abs(item["p_pred"] - item["p_real"]))
    mae = F.round((errors[0] + errors[1] + errors[2]) / 3, 4).alias("mae_pred")
    return p.select("scenario", "gnb", "t", *cols, mae)


def by_slice(loop: DataFrame, *measures: str) -> DataFrame:
    """Wide loop results as one row per (scenario, cell, window, slice)."""
    return loop.select("scenario", "gnb", "t", F.explode(F.array(*[
        F.struct(F.lit(s).alias("slice"), *[F.col(f"{m}_{s}").alias(m) for m in measures])
        for s in dims.SLICES])).alias("s")).select("scenario", "gnb", "t", "s.*")


def sla_reduction(loop: DataFrame, online: bool = False) -> DataFrame:
    """Observed and estimated violation share per cell and slice. Offline, the reduction is
    null and the window shares 0 where less than 0.1 % was observed."""
    g = by_slice(loop, "p_real", "p_sla_opt").groupBy("gnb", "slice").agg(
        (F.avg("p_real") * 100).alias("d"), (F.avg("p_sla_opt") * 100).alias("o"),
        (F.avg((F.col("p_real") > 0).cast("double")) * 100).alias("wd"),
        (F.avg((F.col("p_sla_opt") > 0.05).cast("double")) * 100).alias("wo"))
    d, o = F.col("d"), F.col("o")
    if online:
        red, some = (d - o) / F.greatest(d, F.lit(1e-6)) * 100, F.lit(True)
    else:
        some = d >= 0.1
        red = F.when(some, (d - o) / d * 100)
    return g.select(
        "gnb", "slice", F.round(d, 2).alias("viol_static_pct"),
        F.round(o, 2).alias("viol_opt_pct"), F.round(red, 1).alias("reduction_pct"),
        F.when(some, F.round("wd", 1)).otherwise(0.0).alias("win_viol_static_pct"),
        F.when(some, F.round("wo", 1)).otherwise(0.0).alias("win_viol_opt_pct"))


def reduction_rollup(reduction: DataFrame, online: bool = False) -> DataFrame:
    """Means by slice and by cell; mMTC is left out offline."""
    r = reduction if online else reduction.filter(F.col("slice") != "mMTC")
    return r.groupingSets([["slice"], ["gnb"]], "slice", "gnb").agg(
        *[F.round(F.avg(c), 4).alias(c)
          for c in ("viol_static_pct", "viol_opt_pct", "reduction_pct")])
