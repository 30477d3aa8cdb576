"""Queries of the direct multi-step forecaster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.operators import closed_loop as CL
from slicewise.operators import direct as D
from slicewise.operators import forecast as FC
from slicewise.operators.features import base_features
from slicewise.operators.profile import r6
from slicewise.operators.series import with_positions
from slicewise.plans.etl import SERIES, long_kpi
from slicewise.plans.registry import query
from slicewise.sinks.tables import landed


def direct_fit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The long series with standardised targets, its rows without positions, and the fits."""
    k = long_kpi(spark, sf_dir)
    cut = F.floor(F.col("series_len") * F.lit(dims.TRAIN_RATIO)).alias("cut")
    s = landed(base_features(with_positions(k, SERIES)).select("*", cut), "series")
    scale = landed(D.scales(s.filter("pos < cut")), "scales")
    z = D.scaled(s, scale)
    fits = landed(D.solve_all(D.window_sums(z, SERIES)).join(scale, "slice"), "direct-fits")
    return z, k, fits


def direct_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation windows with the direct forecast beside the line fits and the observation."""
    z, k, fits = direct_fit(spark, sf_dir)
    windows = FC.window_fits(CL.eval_rows(z, k), SERIES, (*D.history(), FC.observed()))
    return D.forecast(windows, fits)


@query
def direct_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of each slice and output: sums of its coefficients, and whether the gradient is nil."""
    fits = direct_fit(spark, sf_dir)[2]
    per = fits.select("slice", "n_windows", (F.col("gradient") < 1e-9).alias("solved"), F.posexplode("w").alias("o", "c"))
    total = lambda f: F.aggregate("c", F.lit(0.0), lambda s, v: s + f(v))
    return per.select("slice", "n_windows", "solved", F.element_at(F.array(*[F.lit(t) for t in D.TARGETS]), (F.floor(
        F.col("o") / dims.HORIZON) + 1).cast("int")).alias("target"),
        (F.col("o") % dims.HORIZON + 1).cast("bigint").alias("step"), F.round(F.element_at("c", -1), 6).alias("constant"),
        F.round(total(lambda v: v), 6).alias("w_sum"), F.round(total(lambda v: v * v), 6).alias("w_squares"))


@query
def forecast_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation window's 15 steps of three targets from one fit per slice."""
    rows = direct_windows(spark, sf_dir).select(*SERIES, "t", F.explode("steps").alias("s"))
    return rows.select(*SERIES, "t", (F.col("s.h") + 1).cast("bigint").alias("step"), F.round("s.thr", 4).alias("thr_pred"),
                       F.round("s.lat", 3).alias("lat_pred"), F.round("s.loss", 4).alias("loss_pred"))


@query
def forecast_direct_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the direct forecast, with the mean errors of the straight line beside them."""
    w = landed(direct_windows(spark, sf_dir), "direct-windows")
    limits = dims.limit_dim(spark, "detect")
    by = ["slice", "gnb"]
    direct = FC.forecast_metrics(FC.window_scores(w, F.col("steps"), SERIES, limits), by)
    line = FC.window_scores(w, FC.trend_steps(), SERIES, limits).groupBy(*by).agg(*[
        F.round(F.avg(f"e_{c}"), 5).alias(f"trend_mae_{c}") for c in ("lat", "loss", "thr")])
    return direct.join(line, by)


@query
def closed_loop_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed loop on loads of the direct forecast."""
    return CL.run_loop(D.direct_loads(direct_windows(spark, sf_dir), SERIES))


@query
def forecast_direct_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = D.direct_loads(direct_windows(spark, sf_dir), SERIES)
    return loads.select(*SERIES, "t", *[r6(F.col(c)).alias(c) for c in ("rho", "p_pred", "p_real")])
