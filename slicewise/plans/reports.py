"""Mode comparison, loop reports, generated scenarios and the combined data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.operators import kpi as K
from slicewise.operators import report as R
from slicewise.operators import scenario as SC
from slicewise.operators.forecast import forecast_metrics
from slicewise.plans.control import allocation, loop_results, window_scores
from slicewise.plans.etl import full_series
from slicewise.plans.registry import query
from slicewise.sinks.tables import landed
from slicewise.sources import fixtures as X

# scenario names of the transitions, as found in the given data
NAMES = {"NormalLoad": "S0", "LowTrafficNight": "S0", "GlobalSaturation": "S1",
         "ModerateLoad_eMBB": "S1"}


def mode_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI rows of the three control modes."""
    b = K.kpi_buckets(X.mode_samples(spark, sf_dir), delay_scale=1.0)
    return K.rounded(K.kpi_formulas(b)).withColumnRenamed("run", "mode")


@query
def mode_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mode_kpis(landed(mode_kpi(spark, sf_dir), "modes"))


@query
def mode_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mode_gain(R.mode_kpis(landed(mode_kpi(spark, sf_dir), "modes")))


@query
def cumulative_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cumulative_violation(landed(mode_kpi(spark, sf_dir), "modes"))


@query
def gain_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gain_by_group(landed(allocation(spark, sf_dir), "allocation"))


@query
def nearly_free_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearly_free(allocation(spark, sf_dir))


@query
def top_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_scenarios(allocation(spark, sf_dir))


def named_block(scenario: Column) -> Column:
    """Listed name of a scenario block: S0 takes the first eight names, S1 the next."""
    run = F.substring(scenario, 2, 1).cast("int")
    block = F.element_at(F.split(scenario, "-"), 2).cast("int")
    return F.get(F.array(*[F.lit(n) for n in dims.SCENARIO_ORDER]), run * 8 + block)


@query
def ordered_gain_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = allocation(spark, sf_dir).withColumn("scenario", named_block(F.col("scenario")))
    return R.ordered_gain_matrix(a)


@query
def score_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = forecast_metrics(window_scores(spark, sf_dir), ["slice", "gnb"])
    return R.score_recommendations(landed(m, "scores"))


@query
def zip_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = full_series(spark, sf_dir)
    spec = dims.inline_table(spark, ["name", "slice", "low", "high"],
                             [("pair", sl, "S0", "S1") for sl in dims.SLICES])
    return SC.zip_series(s, spec).select("slice", "gnb", "pos", "common_len", "low_lat",
                                         "high_lat", "low_loss", "high_loss")


def generated(spark: SparkSession, sf_dir: str, series: DataFrame | None = None) -> DataFrame:
    s = series if series is not None else landed(full_series(spark, sf_dir), "series")
    z = SC.zip_series(s, SC.transition_spec(spark, NAMES))
    return SC.blend(z, SC.linear_weight(), noise=0)


def _published(b: DataFrame) -> DataFrame:
    values = [F.round(c, 6).alias(c) for c in SC.BLENDED]
    return b.select("scenario", "gnb", "slice", "pos", *values, "sla_ok", "ok_ahead",
                    "violated_ahead")


@query
def scenario_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(generated(spark, sf_dir))


@query
def scenario_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = landed(full_series(spark, sf_dir), "series")
    z = SC.zip_series(s, SC.transition_spec(spark, NAMES))
    return _published(SC.blend(z, SC.logistic_weight(), noise=0))


@query
def scenario_violation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.violation_rate(generated(spark, sf_dir))


@query
def combined_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original and generated rows together, reported per scenario and slice."""
    s = landed(full_series(spark, sf_dir, labelled=True), "series")
    both = SC.combined(s.drop("series_len"), generated(spark, sf_dir, s))
    return both.groupBy("scenario", "slice").agg(
        F.count("*").alias("n_rows"), F.countDistinct("gnb").alias("n_cells"),
        F.round(F.avg("lat"), 5).alias("mean_lat"),
        F.round(F.avg((~F.col("sla_ok")).cast("double")) * 100, 5).alias("violation_pct"),
        F.sum(F.col("violated_ahead").cast("bigint")).alias("n_violated_ahead"),
        F.count("lat_source").alias("n_original"))
