"""Loads read off the newest rows of a live series (batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.functions import scalars as S
from slicewise.operators import forecast as FC
from slicewise.operators.allocate import complete_grid, with_facts
from slicewise.operators.series import last_rows

RECENT = 5
SHIFT_FACTOR = 5.0


def observed_load(lat: Column, thr: Column) -> Column:
    """2 where the recent latency is over its limit, else throughput over capacity."""
    return (F.when(lat > F.col("control_lat_max"), 2.0)
            .otherwise(S.throughput_load(thr, F.col("capacity"))))


def reactive_loads(rows: DataFrame, keys: list[str], axis: str = "tick") -> DataFrame:
    """Load from the mean of the newest five rows per series."""
    recent = last_rows(rows, [*keys, "gnb", "slice"], RECENT, axis).groupBy(
        *keys, "gnb", "slice").agg(F.round(F.avg("lat"), 9).alias("lat"),
                                   F.round(F.avg("thr"), 9).alias("thr"),
                                   F.max(axis).alias("last_tick"))
    return with_facts(recent).withColumn("rho", observed_load(F.col("lat"), F.col("thr"))).select(
        *keys, "gnb", "slice", "last_tick", F.round("rho", 9).alias("rho"))


def predictive_loads(rows: DataFrame, keys: list[str], axis: str = "tick") -> DataFrame:
    """Load from the forecast of the newest 60 rows, with the fallbacks: too short a history
    uses the newest throughput; a forecast latency over five times the observed one is not
    trusted and the observed latency decides. ``mode`` names the branch."""
    hist = last_rows(rows, [*keys, "gnb", "slice"], dims.HISTORY, axis).withColumns({
        "h": -F.col("rows_back"), "lat_log": S.log_scaled(F.col("lat"))})
    newest = F.col("rows_back") == 1
    aggs = [F.count("*").alias("n_rows"), F.max(F.when(newest, F.col("thr"))).alias("thr_last"),
            F.round(F.avg(F.when(F.col("rows_back") <= RECENT, F.col("lat"))), 9)
            .alias("lat_recent")]
    for t in ("thr", "lat_log"):
        aggs += [F.round(F.avg(t), 9).alias(f"mean_{t}"),
                 F.round(F.when(F.count("*") > 1, F.regr_slope(t, "h")), 9).alias(f"slope_{t}")]
    return predicted_loads(hist.groupBy(*keys, "gnb", "slice").agg(*aggs), keys)


def predicted_loads(fits: DataFrame, keys: list[str]) -> DataFrame:
    """The ladder of ``predictive_loads`` on means and slopes of the newest rows."""
    f = with_facts(fits)
    f = f.withColumn("lat_pred", FC.mean_latency_ahead())
    shift = F.col("lat_pred") > F.col("lat_recent") * SHIFT_FACTOR
    p = F.when(shift, (F.col("lat_recent") > F.col("control_lat_max")).cast("double")).otherwise(
        FC.late_share(F.col("control_lat_max")))
    f = f.withColumns({"p_viol": p, "shift": shift})
    inv = F.col("curve_rho") - F.log(1.0 / F.greatest("p_viol", F.lit(1e-6)) - 1.0) / F.greatest(
        "curve_k", F.lit(0.01))
    forecast = (F.when(F.col("p_viol") >= 0.99, 2.0)
                .when(F.col("p_viol") <= 0.01, S.throughput_load(
                    FC.mean_over_steps("thr"), F.col("capacity"), 1.5))
                .otherwise(S.clip(inv, 0.0, 2.0)))
    full = F.col("n_rows") >= dims.HISTORY
    return f.select(
        *keys, "gnb", "slice", "n_rows",
        F.when(~full, "fallback_warmup").when(F.col("shift"), "forecast_shift")
        .otherwise("forecast").alias("mode"),
        F.when(full, F.col("p_viol")).alias("p_viol"),
        F.round(F.when(full, forecast).otherwise(
            S.throughput_load(F.col("thr_last"), F.col("capacity"))), 9).alias("rho"))


def fill_missing(loads: DataFrame, keys: list[str]) -> DataFrame:
    """Every (key, cell, slice); where nothing was seen the small default load."""
    out = complete_grid(loads, keys).withColumn(
        "rho", F.coalesce("rho", F.lit(dims.NO_DATA_LOAD)))
    if "mode" in loads.columns:
        out = out.withColumn("mode", F.coalesce("mode", F.lit("fallback_nodata")))
    return out
