"""Load, curve, cost, allocation, forecast and closed-loop queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.operators import allocate as A
from slicewise.operators import closed_loop as CL
from slicewise.operators import forecast as FC
from slicewise.operators import load as L
from slicewise.operators.features import base_features
from slicewise.operators.profile import describe, r6, slice_pivot
from slicewise.operators.series import with_positions
from slicewise.plans.etl import SERIES, kpi_base, kpi_series, long_kpi
from slicewise.plans.profiling import block_scenario
from slicewise.plans.registry import query
from slicewise.sinks.tables import landed


def block_loads(spark: SparkSession, sf_dir: str, ticks: int = 15) -> DataFrame:
    """Load points with the scenario refined to blocks of ticks."""
    k = kpi_base(spark, sf_dir).withColumn("scenario", block_scenario(ticks))
    return L.load_points(k)


def grid_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of every (block, cell, slice), null where a block has no rows."""
    pts = landed(block_loads(spark, sf_dir), "loads")
    return A.complete_grid(pts.select(*SERIES, "rho"), ["scenario"])


def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.problems(grid_loads(spark, sf_dir), ["scenario"])
    return A.allocation_report(A.choose_three(p), ["scenario"])


def loop_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = long_kpi(spark, sf_dir)
    rows = CL.eval_rows(with_positions(k, SERIES), k)
    return rows, FC.window_fits(rows, SERIES)


def loop_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.forecast_loads(loop_parts(spark, sf_dir)[1])


def loop_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.run_loop(loop_loads(spark, sf_dir))


@query
def dim_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity table with the budget test, joined to the rows that use it."""
    d = dims.unit_dim(spark)
    total = d.groupBy("gnb").agg(F.sum("units_default").alias("units_all"))
    n = kpi_base(spark, sf_dir).groupBy("gnb", "slice").agg(F.count("*").alias("n_rows"))
    return n.join(d, ["gnb", "slice"]).join(total, "gnb").select(
        "gnb", "slice", "n_rows", F.col("units_default").cast("bigint").alias("units_default"),
        F.col("budget").cast("bigint").alias("budget"), "unit_rate",
        r6(F.col("capacity")).alias("capacity"),
        (F.col("units_all") == F.col("budget")).alias("budget_met"))


@query
def load_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_loads(spark, sf_dir).select(
        *SERIES, *[r6(F.col(c)).alias(c) for c in
                   ("fraction_lost", "throughput_mean", "capacity", "rho", "offered")])


@query
def describe_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of the loads per slice and overall."""
    return describe(landed(block_loads(spark, sf_dir), "points"), ["slice"], ["rho"])


@query
def calibrate_loss_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = landed(block_loads(spark, sf_dir), "points")
    return L.calibrate(pts).select("gnb", "slice", "curve_k", "curve_rho",
                                   r6(F.col("sse")).alias("sse"))


@query
def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.cost_rows(block_loads(spark, sf_dir))
    return c.select(*SERIES, F.col("n").cast("bigint").alias("n"), r6(F.col("cost")).alias("cost"))


@query
def cost_table_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.cost_rows(block_loads(spark, sf_dir), live=True)
    c = c.filter(F.col("n") >= F.col("units_floor"))
    return c.select(*SERIES, F.col("n").cast("bigint").alias("n"), r6(F.col("cost")).alias("cost"))


@query
def cost_default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario refined to single ticks, some of which lack a slice: cost 1 for every count."""
    pts = landed(block_loads(spark, sf_dir, 1), "loads")
    grid = A.complete_grid(pts.select(*SERIES, "rho"), ["scenario"])
    c = A.cost_rows(grid)
    return c.groupBy(*SERIES).agg(
        F.count("*").alias("n_counts"), F.first(F.col("rho").isNull()).alias("filled"),
        F.round(F.sum("cost"), 5).alias("cost_sum"), r6(F.min("cost")).alias("cost_min"))


@query
def objective_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objective of the default units, read off the cost rows."""
    c = A.cost_rows(grid_loads(spark, sf_dir)).filter(F.col("n") == F.col("units_default"))
    return c.groupBy("scenario", "gnb").agg(r6(F.sum("cost")).alias("F_default"))


@query
def allocate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation(spark, sf_dir)


@query
def allocate_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same problems through the fold that takes any number of slices."""
    p = A.problems(grid_loads(spark, sf_dir), ["scenario"])
    return A.allocation_report(A.choose_fold(p), ["scenario"])


@query
def allocate_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live form: floors, at most the budget, priority on loss."""
    loads = grid_loads(spark, sf_dir).withColumn("rho", F.coalesce("rho", F.lit(dims.NO_DATA_LOAD)))
    p = A.problems(loads, ["scenario"], live=True)
    return A.live_allocation(A.choose_fold(p, exact=False), ["scenario"])


@query
def allocation_vs_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.against_default(allocation(spark, sf_dir), ["scenario"])


@query
def forecast_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = FC.trend_forecast(base_features(kpi_series(spark, sf_dir)), SERIES)
    return f.select(*SERIES, "pos", "step", F.round("thr_pred", 4).alias("thr_pred"),
                    F.round("lat_pred", 3).alias("lat_pred"),
                    F.round("loss_pred", 4).alias("loss_pred"))


@query
def forecast_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = loop_loads(spark, sf_dir)
    return f.select(*SERIES, "t", r6(F.col("rho")).alias("rho"),
                    r6(F.col("p_pred")).alias("p_pred"), F.round("lat_pred", 4).alias("lat_pred"))


@query
def pred_vs_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and observed late share of each window and slice, with the error."""
    rows, fits = loop_parts(spark, sf_dir)
    seen = rows.filter("h >= 0").groupBy(*SERIES, "t").agg(r6(F.avg("late")).alias("p_real"))
    pred = CL.forecast_loads(fits).select(*SERIES, "t", r6(F.col("p_pred")).alias("p_pred"))
    return pred.join(seen, [*SERIES, "t"]).withColumn(
        "abs_error", r6(F.abs(F.col("p_pred") - F.col("p_real"))))


@query
def closed_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loop_results(spark, sf_dir)


@query
def closed_loop_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop with loss curves fitted to the same series in blocks of 15 rows."""
    k = long_kpi(spark, sf_dir)
    s = landed(with_positions(k, SERIES), "series")
    lim = dims.limit_dim(spark, "detect").select("slice", "lat_max")
    blocks = s.join(lim, "slice").withColumn("block", F.floor(F.col("pos") / 15))
    curves = landed(L.calibrate(landed(
        L.load_points(blocks, ("scenario", "gnb", "slice", "block")), "points")), "curves")
    fits = FC.window_fits(CL.eval_rows(s, k), SERIES)
    return CL.run_loop(CL.forecast_loads(fits, curves), curves)


@query
def post_alloc_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.by_slice(loop_results(spark, sf_dir), "rho", "p_sla_opt", "p_real")


@query
def sla_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.sla_reduction(loop_results(spark, sf_dir))


@query
def load_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean predicted load per scenario, one column per slice."""
    loads = CL.by_slice(loop_results(spark, sf_dir), "rho")
    return slice_pivot(loads, "scenario", r6(F.avg("rho")))


@query
def reduction_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduction of the violation share, slices by cells."""
    red = CL.sla_reduction(loop_results(spark, sf_dir))
    return red.groupBy("slice").pivot("gnb", dims.CELLS).agg(F.max("reduction_pct"))


@query
def sla_reduction_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-ups of the offline report (without mMTC) and of the online one."""
    loop = landed(loop_results(spark, sf_dir), "loop")
    parts = [CL.reduction_rollup(CL.sla_reduction(loop, o), o).withColumn("online", F.lit(o))
             for o in (False, True)]
    return parts[0].unionByName(parts[1])


@query
def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FC.forecast_metrics(window_scores(spark, sf_dir), ["slice", "gnb"])


def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = long_kpi(spark, sf_dir)
    fits = FC.window_fits(CL.eval_rows(with_positions(k, SERIES), k), SERIES, (FC.observed(),))
    return FC.window_scores(fits, FC.trend_steps(), SERIES, dims.limit_dim(spark, "detect"))


@query
def prediction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    loop = loop_results(spark, sf_dir)
    return FC.prediction_quality(CL.by_slice(loop, "p_pred", "p_real"), ["slice"])
