"""Queries of the raw-signal to KPI chain, and the KPI tables other queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slicewise.operators import kpi as K
from slicewise.operators.series import with_positions
from slicewise.plans.registry import query
from slicewise.sinks.tables import landed
from slicewise.sources import fixtures as X

SERIES = ["scenario", "gnb", "slice"]


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregated samples of the given event stream (delays are in ms already)."""
    return K.kpi_buckets(X.raw_samples(spark, sf_dir), delay_scale=1.0)


def kpi_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI rows without label and filled jitter: one scan, one shuffle."""
    return K.rounded(K.kpi_formulas(buckets(spark, sf_dir)))


def kpi_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI rows with the look-ahead label; flags are taken before rounding."""
    return K.rounded(K.label_ahead(K.kpi_formulas(buckets(spark, sf_dir))))


def kpi_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns. The aggregated buckets, small beside the raw samples, are landed so that
    the raw scan is not repeated for the series positions behind the jitter fill."""
    b = landed(buckets(spark, sf_dir), "buckets")
    return K.rounded(K.label_ahead(K.fill_jitter(K.kpi_formulas(b))))


def kpi_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI rows (no jitter) with their position in the series."""
    return with_positions(landed(kpi_base(spark, sf_dir), "kpi"), SERIES)


def full_series(spark: SparkSession, sf_dir: str, labelled: bool = False) -> DataFrame:
    """All measures with their position in the series; the look-ahead label where asked."""
    if labelled:
        kpi = kpi_full(spark, sf_dir)
    else:
        b = landed(buckets(spark, sf_dir), "buckets")
        kpi = K.rounded(K.fill_jitter(K.kpi_formulas(b)))
    return with_positions(landed(kpi, "kpi"), SERIES)


def long_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long KPI series, landed."""
    return landed(X.lineitem_kpi(spark, sf_dir), "long_kpi")


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long KPI series with positions."""
    return with_positions(long_kpi(spark, sf_dir), SERIES)


@query
def kpi_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets(spark, sf_dir)


@query
def kpi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi_full(spark, sf_dir)


@query
def sla_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sla_summary(kpi_labelled(spark, sf_dir))


@query
def run_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.run_duration(X.raw_samples(spark, sf_dir))


@query
def label_range_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi_labelled(spark, sf_dir).select("run", "slice", "gnb", "tick", "sla_ok",
                                              "ok_ahead", "violated_ahead")
