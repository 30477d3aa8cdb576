"""Parameter averaging, local fits, Huber forecaster and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.operators import features as FE
from slicewise.operators import federated as FD
from slicewise.operators import forecast as FC
from slicewise.operators import robust as R
from slicewise.operators import windows as W
from slicewise.operators.joins import join_groups
from slicewise.operators.profile import r6
from slicewise.plans.etl import SERIES, long_series
from slicewise.plans.registry import query
from slicewise.sinks.tables import landed
from slicewise.sources import fixtures as X

FEATURES = [f"{c}{k}" for c in FE.TARGETS for k in ("", "_trend", "_vol")]


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and future means of the long series, with the temporal split."""
    f = FE.training_features(FE.base_features(long_series(spark, sf_dir)), SERIES)
    s = FC.supervised(f, SERIES)
    cut = F.floor(F.col("series_len") * F.lit(dims.TRAIN_RATIO))
    return landed(s.withColumn("is_train", F.col("pos") + dims.HORIZON < cut).select(
        *SERIES, "pos", "is_train", *FEATURES, *[f"y_{t}" for t in FE.TARGETS]), "training")


@query
def federated_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of every parameter over all vectors of a slice."""
    v = X.param_vectors(spark, sf_dir).select("slice", F.posexplode("embedding").alias("idx", "value"))
    a = FD.federated_average(v.select("slice", X.param_name(F.col("idx")).alias("param"),
                                      F.col("idx").cast("bigint").alias("idx"), F.col("value").cast("double")))
    return a.select("slice", "param", "idx", r6(F.col("value")).alias("value"),
                    F.col("n_cells").alias("n_vectors"))


@query
def parameter_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the last vector of a cell from its first, mean distance of all its vectors from
    it, and the divergence of the cells of a slice."""
    p = landed(X.model_params(spark, sf_dir), "params")
    d = FD.parameter_drift(p).join(FD.divergence(p), "slice", "left")
    every = FD.drift_of_all(X.param_vectors(spark, sf_dir))
    return d.join(every, ["slice", "gnb"]).select(
        "slice", "gnb", r6(F.col("l2")).alias("l2"), r6(F.col("divergence")).alias("divergence"),
        "n_vectors", r6(F.col("l2_mean")).alias("l2_mean"))


@query
def federated_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = training_table(spark, sf_dir).filter("is_train")
    sums = landed(FD.normal_sums(t, FEATURES, "y_lat_log"), "sums")
    return FD.federated_fit(sums, len(FEATURES)).select(
        "slice", "gnb", "idx", r6(F.col("local")).alias("local"),
        r6(F.col("average")).alias("average"), r6(F.col("proximal")).alias("proximal"))


@query
def forecast_huber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forecaster per slice and target of the mean over the horizon; error on the last fifth of
    every series, and whether the gradient of the loss is nil."""
    targets = [f"y_{t}" for t in FE.TARGETS]
    z, scale = R.standardised(training_table(spark, sf_dir), FEATURES + targets, F.col("is_train"), ["slice"])
    z = landed(z, "standardised")
    fits = landed(R.huber_fit(z.filter("is_train"), FEATURES, targets, ["slice"]), "huber-fits")
    test = join_groups(R.predict(z.filter("NOT is_train"), fits, FEATURES, targets, ["slice"]), scale, ["slice"])
    scores = test.groupBy("slice").agg(F.count("*").alias("n_test"), *[
        F.avg(F.abs(F.col(f"p_{y}") - F.col(y)) * F.col(f"s_{y}")).alias(y) for y in targets])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"y_{t}").alias("mae")) for t in FE.TARGETS]))
    return (scores.join(fits, "slice").select("slice", F.col("n").alias("n_train"), "n_test",
                                              (F.col("gradient") < 1e-7).alias("solved"), each.alias("e"))
            .select("slice", "e.target", "n_train", "n_test", "solved", F.round("e.mae", 5).alias("mae")))


@query
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn windows per series against what their weights ask for; as many draws a slice as windows."""
    w = landed(W.window_weights(long_series(spark, sf_dir), SERIES), "weights")
    drawn = FD.weighted_sample(w).groupBy(*SERIES).agg(
        F.count("*").alias("n_drawn"), F.countDistinct("start").alias("n_distinct"), F.sum("draw").alias("draw_sum"))
    all_n = w.groupBy(*SERIES).agg(F.count("*").alias("n_windows"),
                                   r6(F.sum("weight")).alias("weight_sum"))
    return all_n.join(drawn, SERIES)


@query
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the parts, exact to the row, and which windows they hold."""
    w = W.window_weights(long_series(spark, sf_dir), SERIES)
    return (FD.split_parts(w, [*SERIES, "start"]).groupBy("slice", "part")
            .agg(F.count("*").alias("n"), F.sum("start").alias("start_sum")))
