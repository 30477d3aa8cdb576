"""Transition scenarios blended from a quiet and a busy series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.functions import scalars as S
from slicewise.operators.kpi import label_ahead_rows
from slicewise.operators.series import CHUNK

KEYS = ["scenario", "gnb", "slice"]
BLENDED = ["thr", "lat", "jit", "loss", "load"]

# fixed values: name, slice, first scenario, second scenario, start and end of the transition
TRANSITIONS = [
    ("Trans_RampUp_eMBB", "eMBB", "NormalLoad", "GlobalSaturation", 0.3, 0.7),
    ("Trans_RampDown_eMBB", "eMBB", "GlobalSaturation", "NormalLoad", 0.3, 0.7),
    ("Trans_Peak_eMBB", "eMBB", "NormalLoad", "GlobalSaturation", 0.4, 0.6),
    ("Trans_Gradual_eMBB", "eMBB", "NormalLoad", "GlobalSaturation", 0.6, 0.9),
    ("Trans_LowViol_eMBB", "eMBB", "NormalLoad", "GlobalSaturation", 0.75, 0.95),
    ("Trans_RampUp_URLLC", "URLLC", "LowTrafficNight", "GlobalSaturation", 0.3, 0.7),
    ("Trans_RampDown_URLLC", "URLLC", "GlobalSaturation", "LowTrafficNight", 0.3, 0.7),
    ("Trans_Peak_URLLC", "URLLC", "LowTrafficNight", "GlobalSaturation", 0.4, 0.6),
    ("Trans_Gradual_URLLC", "URLLC", "LowTrafficNight", "GlobalSaturation", 0.6, 0.9),
    ("Trans_LowViol_URLLC", "URLLC", "LowTrafficNight", "GlobalSaturation", 0.75, 0.95),
    ("Trans_RampUp_mMTC", "mMTC", "NormalLoad", "ModerateLoad_eMBB", 0.3, 0.7),
    ("Trans_RampDown_mMTC", "mMTC", "ModerateLoad_eMBB", "NormalLoad", 0.3, 0.7),
    ("Trans_Gradual_mMTC", "mMTC", "NormalLoad", "ModerateLoad_eMBB", 0.6, 0.9),
    ("Trans_LowViol_mMTC", "mMTC", "NormalLoad", "ModerateLoad_eMBB", 0.75, 0.95),
]
STEEPNESS = 180.0
NOISE = 0.02


def transition_spec(spark: SparkSession, names: dict[str, str] | None = None) -> DataFrame:
    """The transitions as a table; ``names`` maps scenario names to those of the data."""
    names = names or {}
    rows = [(n, s, names.get(a, a), names.get(b, b), f, t) for n, s, a, b, f, t in TRANSITIONS]
    return dims.inline_table(spark, ["name", "slice", "low", "high", "from_share", "to_share"],
                             rows)


def zip_series(series: DataFrame, spec: DataFrame) -> DataFrame:
    """Rows of two series at the same position, up to the shorter one. ``series`` carries
    positions; ``spec`` has name, slice, low, high."""
    cols = [c for c in BLENDED if c in series.columns]

    def side(which: str) -> DataFrame:
        return series.select(
            F.col("scenario").alias(which), "slice", "gnb", "pos",
            F.col("series_len").alias(f"{which}_len"),
            *[F.col(c).alias(f"{which}_{c}") for c in cols])
    j = side("low").join(spec, ["slice", "low"]).join(side("high"), ["slice", "gnb", "high", "pos"])
    t = F.least("low_len", "high_len")
    return j.withColumn("common_len", t).filter(F.col("pos") < t).drop("low_len", "high_len")


def linear_weight() -> Column:
    """0 before the start, 1 from the end, even steps between (reaching 1 one step early)."""
    start = F.floor(F.col("common_len") * F.col("from_share"))
    end = F.floor(F.col("common_len") * F.col("to_share"))
    steps = F.greatest(end - start - 1, F.lit(1))
    return (F.when(F.col("pos") < start, 0.0).when(F.col("pos") >= end, 1.0)
            .otherwise((F.col("pos") - start) / steps))


def logistic_weight(steepness: float = STEEPNESS) -> Column:
    mid = F.col("common_len") / 2.0
    return 1.0 / (1.0 + F.exp(-(F.col("pos") - mid) / steepness))


def blend(zipped: DataFrame, weight: Column, noise: float = NOISE, seed: int = 42,
          chunk: int = CHUNK) -> DataFrame:
    """Blended measures kept in their physical range, service level recomputed, and the
    row-based look-ahead label."""
    z = zipped.withColumn("_a", weight)
    top = {"loss": 100.0, "load": 100.0, "lat": 600000.0}
    vals = {}
    for i, c in enumerate(BLENDED):
        mixed = (1.0 - F.col("_a")) * F.col(f"low_{c}") + F.col("_a") * F.col(f"high_{c}")
        vals[c] = S.clip(S.relative_noise(mixed, noise, seed + i, "name", "gnb", "slice",
                                       "pos"), 0.0, top.get(c))
    lim = dims.limit_dim(z.sparkSession, "detect")
    b = z.withColumns(vals).join(lim, "slice")
    ok = (F.col("lat") <= F.col("lat_max")) & (F.col("loss") <= F.col("loss_max"))
    b = b.select(F.col("name").alias("scenario"), "gnb", "slice", "pos", *BLENDED,
                 ok.alias("sla_ok"))
    return label_ahead_rows(b, KEYS, chunk=chunk)


def violation_rate(generated: DataFrame) -> DataFrame:
    return generated.groupBy("scenario", "slice").agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg((~F.col("sla_ok")).cast("double")) * 100, 1).alias("viol_rate_pct"))


def combined(original: DataFrame, generated: DataFrame) -> DataFrame:
    return original.unionByName(generated, allowMissingColumns=True)
