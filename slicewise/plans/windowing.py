"""Feature, label and window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.operators import features as FE
from slicewise.operators import kpi as K
from slicewise.operators import windows as W
from slicewise.operators.closed_loop import eval_rows
from slicewise.operators.profile import r6
from slicewise.operators.series import last_rows, with_positions
from slicewise.plans.etl import SERIES, full_series, kpi_base, kpi_series, long_kpi, long_series
from slicewise.plans.registry import query
from slicewise.sources import fixtures as X


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.training_features(FE.base_features(full_series(spark, sf_dir)), SERIES)


@query
def label_rows_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (K.label_ahead_rows(kpi_series(spark, sf_dir), SERIES)
            .select(*SERIES, "pos", "sla_ok", "ok_ahead", "violated_ahead"))


@query
def feature_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = FE.base_features(kpi_base(spark, sf_dir))
    return k.select(*SERIES, "tick", r6(F.col("lat_log")).alias("lat_log"),
                    r6(F.expm1("lat_log")).alias("lat_back"))


@query
def feature_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = featured(spark, sf_dir)
    return f.select(*SERIES, "pos", *[r6(F.col(f"{c}_trend")).alias(f"{c}_trend")
                                      for c in FE.BASE])


@query
def feature_vol_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = featured(spark, sf_dir)
    return f.select(*SERIES, "pos", *[r6(F.col(f"{c}_vol")).alias(f"{c}_vol") for c in FE.BASE])


@query
def feature_vol_serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving features of the newest 60 rows of each series."""
    s = FE.base_features(full_series(spark, sf_dir))
    first = F.greatest(F.col("series_len") - dims.HISTORY, F.lit(0))
    hist = s.filter(F.col("pos") >= first).withColumn("hist_idx", F.col("pos") - first)
    f = FE.serving_features(hist, SERIES)
    return f.select(*SERIES, "hist_idx", r6(F.col("lat_log_trend")).alias("lat_log_trend"),
                    *[r6(F.col(f"{c}_vol")).alias(f"{c}_vol") for c in FE.BASE])


@query
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = featured(spark, sf_dir)
    return f.select(*SERIES, "pos", *[r6(F.col(c)).alias(c) for c in FE.ALL])


@query
def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = FE.fit_scaler(featured(spark, sf_dir), FE.ALL)
    return s.select("slice", "feature", r6(F.col("mean")).alias("mean"),
                    r6(F.col("std")).alias("std"))


@query
def scaler_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised targets and what the inverse gives back."""
    k = FE.base_features(long_kpi(spark, sf_dir)).select(*SERIES, "tick", *FE.TARGETS)
    sc = FE.fit_scaler(k, FE.TARGETS)
    z = FE.apply_scaler(k, sc, FE.TARGETS)
    back = FE.apply_scaler(z.withColumns({f"z_{c}": F.col(c) for c in FE.TARGETS}), sc,
                           FE.TARGETS, inverse=True)
    return back.select(*SERIES, "tick", *[F.round(f"z_{c}", 5).alias(f"z_{c}")
                                          for c in FE.TARGETS],
                       *[r6(F.col(c)).alias(f"back_{c}") for c in FE.TARGETS])


@query
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window's arrays, reported by their sizes, ends and sums."""
    w = W.sequence_windows(featured(spark, sf_dir), SERIES, FE.ALL, FE.TARGETS)

    def total(arr: str, field: str):
        return r6(F.aggregate(arr, F.lit(0.0), lambda a, e: a + e[field]))
    return w.select(
        *SERIES, "start", F.size("x").cast("bigint").alias("x_rows"),
        F.size("y").cast("bigint").alias("y_rows"),
        r6(F.col("x")[0]["lat_log"]).alias("x_first_lat_log"),
        r6(F.element_at("x", -1)["lat_log"]).alias("x_last_lat_log"),
        total("x", "thr").alias("x_thr"), total("x", "lat_log_vol").alias("x_lat_vol"),
        total("y", "thr").alias("y_thr"), total("y", "lat_log").alias("y_lat_log"),
        total("y", "loss").alias("y_loss"))


@query
def window_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.window_weights(long_series(spark, sf_dir), SERIES)
    return w.select(*SERIES, "start", r6(F.col("weight")).alias("weight"))


@query
def window_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows per slice with their weights, the split sizes and the share of lossy rows."""
    k = long_kpi(spark, sf_dir)
    weights = W.window_weights(with_positions(k, SERIES), SERIES).groupBy("slice").agg(
        F.count("*").alias("n_windows"), r6(F.avg("weight")).alias("mean_weight"),
        r6(F.max("weight")).alias("max_weight"))
    parts = W.temporal_split(W.series_lengths(k, SERIES)).groupBy("slice").agg(
        F.count(F.when(F.col("part") != "test", 1)).alias("n_train"),
        F.count(F.when(F.col("part") == "test", 1)).alias("n_test"))
    lossy = k.groupBy("slice").agg(
        r6(F.avg((F.col("loss") > 0).cast("double")) * 100).alias("lossy_pct"))
    return weights.join(parts, "slice").join(lossy, "slice")


@query
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.temporal_split(W.series_lengths(X.lineitem_kpi(spark, sf_dir), SERIES))


@query
def aligned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.aligned_cells(W.series_lengths(kpi_base(spark, sf_dir), SERIES))


@query
def eval_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed late share of each complete evaluation window."""
    k = long_kpi(spark, sf_dir)
    rows = eval_rows(with_positions(k, SERIES), k).filter("h >= 0")
    return rows.groupBy(*SERIES, "t").agg(F.count("*").alias("n_rows"),
                                          r6(F.avg("late")).alias("p_real"))


@query
def last_n_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 60 rows per series with their age, and whether they are among the last 5."""
    rows = last_rows(kpi_base(spark, sf_dir), SERIES, dims.HISTORY)
    return rows.select(*SERIES, "tick", F.col("rows_back").cast("bigint").alias("rows_back"),
                       (F.col("rows_back") <= 5).alias("in_last_5"))
