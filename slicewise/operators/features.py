"""Model features: scaled values, trend, volatility, standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from slicewise.functions import scalars as S
from slicewise.operators.joins import join_groups
from slicewise.operators.series import CHUNK, over_frames

# The features are addressed by name everywhere, never by position.
BASE = ["thr", "lat_log", "loss", "jit_log", "load"]
ALL = BASE + [f"{c}_{kind}" for c in BASE for kind in ("trend", "vol")]
TARGETS = ["thr", "lat_log", "loss"]


def base_features(kpi: DataFrame) -> DataFrame:
    """The five base columns; a missing jitter or load column counts as zero."""
    have = kpi.columns
    jit = S.log_scaled(F.col("jit")) if "jit" in have else F.lit(0.0)
    load = F.col("load") if "load" in have else F.lit(0.0)
    return kpi.withColumns({"lat_log": S.log_scaled(F.col("lat")), "jit_log": jit, "load": load})


def trend(c: str, w: WindowSpec) -> Column:
    return F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))


def volatility(c: str, w: WindowSpec) -> Column:
    """Training form: sample spread of up to five rows, 0 for the first row."""
    return F.coalesce(F.stddev_samp(c).over(w.rowsBetween(-4, 0)), F.lit(0.0))


def training_features(series: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """All 15 features of every row. Needs ``pos``; one exchange for all of them."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in BASE:
            out[f"{c}_trend"] = trend(c, w)
            out[f"{c}_vol"] = volatility(c, w)
        return out
    return over_frames(series, keys, "pos", cols, before=4, chunk=chunk)


def serving_features(history: DataFrame, keys: list[str], axis: str = "hist_idx",
                     chunk: int = CHUNK) -> DataFrame:
    """Inference form over one bounded history per key: population spread, and 0 until five
    rows of the history itself are there. ``axis`` counts from the start of the history."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        five = w.rowsBetween(-4, 0)
        out = {}
        for c in BASE:
            out[f"{c}_trend"] = trend(c, w)
            out[f"{c}_vol"] = F.when(F.col(axis) >= 4, F.stddev_pop(c).over(five)).otherwise(0.0)
        return out
    return over_frames(history, keys, axis, cols, before=4, chunk=chunk)


def fit_scaler(rows: DataFrame, columns: list[str], keys: tuple[str, ...] = ("slice",)
               ) -> DataFrame:
    """Mean and population spread per slice, long form (slice, feature, mean, std).
    A constant feature gets spread 1."""
    agg = rows.groupBy(*keys).agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    return agg.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"),
                 F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}")).otherwise(1.0).alias("std"))
        for c in columns])).alias("f")).select(*keys, "f.*")


def apply_scaler(rows: DataFrame, scaler: DataFrame, columns: list[str],
                 keys: tuple[str, ...] = ("slice",), inverse: bool = False) -> DataFrame:
    """Standardise (or restore) the columns; one row of the scaler per key is joined."""
    wide = scaler.groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == c, F.col(v))).alias(f"{p}_{c}")
          for c in columns for p, v in (("m", "mean"), ("s", "std"))])
    j = join_groups(rows, wide, list(keys))
    out = {c: (F.col(c) * F.col(f"s_{c}") + F.col(f"m_{c}")) if inverse
           else (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in columns}
    return j.withColumns(out).drop(*[f"{p}_{c}" for c in columns for p in "ms"])
