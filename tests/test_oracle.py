"""Registered queries against their SQL. A representative part by default; all of them with
SLICEWISE_ALL=1 (or ``python tests/compare.py <sf_dir>``)."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = os.environ.get("SLICEWISE_SF", "/root/testdata/sf0.01")
PART = ["sla_summary", "kpi_table", "samples_with_keys", "describe_kpi", "mean_loss_grains",
        "feature_matrix", "feature_vol_serve", "temporal_split", "window_weight", "allocate_exact",
        "allocate_fold", "allocate_priority", "calibrate_loss_curve", "closed_loop",
        "forecast_metrics", "scenario_linear", "mode_kpis", "kpi_csv_roundtrip",
        "predictive_load", "closed_loop_online", "stream_allocation", "weighted_sample",
        "random_split", "federated_average", "federated_fit", "forecast_huber", "forecast_direct_metrics", "parameter_drift", "scan_scalar_totals"]
TEXT_ONLY = {n for n in entry.queries() if n == "pipeline" or n in (
    "op6_quality", "op7_linededup", "op8_simhash", "op9_langid", "op12_whitening", "op13_fingerprints")}
NAMES = sorted(entry.queries()) if os.environ.get("SLICEWISE_ALL") else PART


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, msg = compare(spark, con, name, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    no_sql = set(entry.queries()) - set(entry.oracle_sql())
    assert no_sql == TEXT_ONLY


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["slice", "gnb", "n_rows", "violation_pct", "mean_latency_ms",
                          "n_measured"]
    assert df.count() > 0
