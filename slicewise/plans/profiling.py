"""Data-quality, profile and classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.functions import naming
from slicewise.operators import profile as P
from slicewise.operators.series import with_positions
from slicewise.plans.etl import SERIES, kpi_base
from slicewise.plans.registry import query
from slicewise.sinks.tables import landed
from slicewise.sources import fixtures as X


def landed_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For reports that pass over the KPI rows more than once."""
    return landed(kpi_base(spark, sf_dir), "kpi")


@query
def classify_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.raw_samples(spark, sf_dir).groupBy("module", "signal").agg(F.count("*").alias("n"))
    return s.select("module", "signal", "n", naming.slice_of(F.col("module")).alias("slice"),
                    naming.cell_of(F.col("module")).alias("gnb"))


@query
def dq_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.quality_counts(kpi_base(spark, sf_dir))


@query
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dataset_profile(kpi_base(spark, sf_dir))


@query
def describe_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.describe(landed_kpi(spark, sf_dir), ["slice"])


@query
def mean_loss_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mean_loss_grains(kpi_base(spark, sf_dir))


@query
def loss_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.label_pivot(kpi_base(spark, sf_dir), P.r6(F.avg("loss")))


@query
def loss_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.loss_classes(kpi_base(spark, sf_dir))


@query
def loss_class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.loss_class_table(kpi_base(spark, sf_dir))


@query
def latency_violation_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.round(F.avg((F.col("lat") > F.col("lat_max")).cast("double")) * 100, 6)
    return P.label_pivot(kpi_base(spark, sf_dir), late)


@query
def latency_max_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.slice_pivot(kpi_base(spark, sf_dir), "scenario", F.max("lat"))


@query
def mean_loss_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.slice_pivot(kpi_base(spark, sf_dir), "gnb", P.r6(F.avg("loss")))


@query
def kpi_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.correlations(kpi_base(spark, sf_dir))


@query
def loss_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.loss_histogram(landed_kpi(spark, sf_dir))


@query
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latency_histogram(landed_kpi(spark, sf_dir))


@query
def loss_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.five_numbers(landed_kpi(spark, sf_dir))


@query
def readiness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.readiness_checks(kpi_base(spark, sf_dir))


@query
def high_loss_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the scenario is refined to blocks of 15 ticks, which spreads the means
    k = kpi_base(spark, sf_dir).withColumn("scenario", block_scenario())
    return P.high_loss_cells(k)


def block_scenario(ticks: int = 15):
    return F.concat_ws("-", "scenario",
                       F.floor(F.col("tick") / ticks).cast("bigint").cast("string"))


@query
def latency_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latency_violations(kpi_base(spark, sf_dir))


@query
def binary_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (P.binary_loss(kpi_base(spark, sf_dir))
            .select(*SERIES, "tick", "lat", "lat_limit", "late", "is_valid"))


@query
def optional_column_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows once without the loss column and once without packet count too."""
    live = X.live_rows(landed_kpi(spark, sf_dir))
    parts = [P.optional_columns(live.drop("pkt_loss_pct")),
             P.optional_columns(live.drop("pkt_loss_pct", "pkt_count")),
             P.optional_columns(live)]
    rows = [p.select(F.lit(i).alias("variant"), "gnb", "slice", "lat_max", "pkt_loss_pct",
                     "avg_latency_ms") for i, p in enumerate(parts)]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.groupBy("variant", "gnb", "slice").agg(
        F.count("*").alias("n"), F.max("lat_max").alias("lat_max"),
        P.r6(F.avg("pkt_loss_pct")).alias("mean_loss"),
        P.share(F.col("avg_latency_ms") > F.col("lat_max")).alias("late_pct"))


@query
def series_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ordered profile: equality filter on slice, cell and scenario."""
    one = kpi_base(spark, sf_dir).filter((F.col("slice") == "URLLC")
                                         & (F.col("gnb") == "Commerce")
                                         & (F.col("scenario") == "S1"))
    return (with_positions(landed(one, "kpi"), SERIES)
            .select("pos", "tick", "lat", "loss").orderBy("tick"))


@query
def series_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series long enough for one history and one horizon."""
    need = dims.HISTORY + dims.HORIZON
    n = kpi_base(spark, sf_dir).groupBy(*SERIES).agg(F.count("*").alias("n_ticks"))
    return n.filter(F.col("n_ticks") >= need)
