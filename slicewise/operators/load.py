"""Offered load of each cell and slice, and the loss curve fitted to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.functions import scalars as S
from slicewise.operators.joins import join_small
from slicewise.sinks.tables import landed

# fixed values: bounds of the loss curve
K_MIN, K_MAX, RHO_MIN, RHO_MAX = 0.5, 50.0, 0.05, 3.0

# Candidates are whole numbers, k in steps of 1/200 and rho_c in steps of 1/2000, so that no
# rounding is needed per evaluation.
K_UNIT, RHO_UNIT = 200, 2000
# grid: candidates, candidates per row, first step, step width
GRID = (6000, 60, 1, 100)
REFINED = [(441, 21, -10, 10), (441, 21, -10, 1)]


def load_points(kpi: DataFrame, keys: tuple[str, ...] = ("scenario", "gnb", "slice")
                ) -> DataFrame:
    """Fraction of late rows, mean throughput, load and offered traffic per group. ``kpi``
    carries ``lat_max`` of the detection profile."""
    limit = S.relaxed_latency_limit(F.col("slice"), F.col("lat_max"))
    agg = kpi.groupBy(*keys).agg(
        F.round(F.avg((F.col("lat") > limit).cast("double")), 9).alias("fraction_lost"),
        F.round(F.avg("thr"), 9).alias("throughput_mean"))
    units = dims.unit_dim(kpi.sparkSession).select("gnb", "slice", "capacity")
    rho = S.observed_load(F.col("throughput_mean"), F.col("capacity"), F.col("fraction_lost"))
    return (agg.dropna(subset=["fraction_lost", "throughput_mean"])
            .join(units, ["gnb", "slice"])
            .withColumn("rho", rho)
            .withColumn("offered", F.col("rho") * F.col("capacity")))


def calibrate(points: DataFrame) -> DataFrame:
    """Least-squares logistic curve per (gnb, slice) over columns ``rho`` and
    ``fraction_lost``.

    A coarse grid and two finer grids around the best point. Equal points are merged first;
    each point then meets the candidates of the grid in a projection and the squared errors
    are summed map-side, so a cell with most of the points still sends one partial sum per
    candidate and map task. The number of candidates is fixed.
    """
    pts = (points.withColumns({"rho": F.round("rho", 9), "p": F.col("fraction_lost")})
           .groupBy("gnb", "slice", "rho", "p").agg(F.count("*").alias("weight")))
    enough = pts.groupBy("gnb", "slice").agg(F.count("*").alias("n_points"))
    # few bytes but thousands of evaluations per point: spread over the cores, whatever the
    # size of the table
    pts = pts.repartition(points.sparkSession.sparkContext.defaultParallelism, "rho", "p")

    best = _best(pts.withColumns({"_k0": F.lit(0), "_r0": F.lit(0)}), GRID)
    for grid in REFINED:
        start = best.select("gnb", "slice", F.col("_k").alias("_k0"), F.col("_r").alias("_r0"))
        best = _best(join_small(pts, landed(start, "curves"), ["gnb", "slice"]), grid)

    fits = F.col("n_points") >= 2
    return best.join(enough, ["gnb", "slice"]).select(
        "gnb", "slice",
        F.when(fits, F.col("_k") / K_UNIT).otherwise(dims.DEFAULT_CURVE[0]).alias("curve_k"),
        F.when(fits, F.col("_r") / RHO_UNIT).otherwise(dims.DEFAULT_CURVE[1]).alias("curve_rho"),
        "sse")


def _best(pts: DataFrame, grid: tuple[int, int, int, int]) -> DataFrame:
    """Best candidate per (gnb, slice) on a grid around the centre ``_k0``, ``_r0``."""
    n, per_row, first, step = grid
    i = F.col("i")
    k = F.col("_k0") + ((i / per_row).cast("int") + first) * step
    rho_c = F.col("_r0") + (i % per_row + first) * step
    err = S.logistic(F.col("rho"), F.col("_k") / K_UNIT, F.col("_r") / RHO_UNIT) - F.col("p")
    sse = (pts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
           .withColumns({"_k": k, "_r": rho_c})
           .filter(F.col("_k").between(int(K_MIN * K_UNIT), int(K_MAX * K_UNIT))
                   & F.col("_r").between(int(RHO_MIN * RHO_UNIT), int(RHO_MAX * RHO_UNIT)))
           .groupBy("gnb", "slice", "_k", "_r")
           .agg(F.round(F.sum(F.col("weight") * err * err), 9).alias("sse")))
    top = sse.groupBy("gnb", "slice").agg(F.min(F.struct("sse", "_k", "_r")).alias("b"))
    return top.select("gnb", "slice", "b._k", "b._r", "b.sse")
