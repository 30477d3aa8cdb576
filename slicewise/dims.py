"""Dimension tables: cells, service slices, limits and default curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------
SLICES = ["eMBB", "URLLC", "mMTC"]
CELLS = ["Macro", "Commerce", "Industrie"]

# cell, unit budget
BUDGETS = [("Macro", 50), ("Commerce", 35), ("Industrie", 25)]

# cell, slice, default units, rate per unit (Mbps), unit floor, curve k, curve rho_c
UNITS = [
    ("Macro", "eMBB", 20, 0.560, 5, 4.68, 0.798),
    ("Macro", "URLLC", 17, 0.125, 10, 2.91, 1.093),
    ("Macro", "mMTC", 13, 0.050, 1, 10.50, 1.245),
    ("Commerce", "eMBB", 21, 0.229, 5, 5.93, 1.404),
    ("Commerce", "URLLC", 11, 0.097, 7, 15.27, 0.406),
    ("Commerce", "mMTC", 3, 0.050, 1, 10.51, 1.245),
    ("Industrie", "eMBB", 6, 0.400, 3, 1.33, 2.304),
    ("Industrie", "URLLC", 12, 0.195, 8, 4.67, 1.307),
    ("Industrie", "mMTC", 7, 0.050, 1, 11.88, 1.444),
]

# cell, slice, units of a start that is too small for eMBB
DEMO_UNITS = [
    ("Macro", "eMBB", 15), ("Macro", "URLLC", 22), ("Macro", "mMTC", 13),
    ("Commerce", "eMBB", 15), ("Commerce", "URLLC", 14), ("Commerce", "mMTC", 6),
    ("Industrie", "eMBB", 4), ("Industrie", "URLLC", 14), ("Industrie", "mMTC", 7),
]

# profile, slice, minimum Mbps, maximum ms, maximum loss %
LIMITS = [
    ("detect", "eMBB", 10.0, 50.0, 1.0),
    ("detect", "URLLC", 0.5, 20.0, 0.001),
    ("detect", "mMTC", 0.0003, 8.8, 1.0),
    ("control", "eMBB", 10.0, 60.0, 1.0),
    ("control", "URLLC", 0.5, 25.0, 0.001),
    ("control", "mMTC", 0.0003, 300.0, 1.0),
]

# slice, order, queue capacity (Mbps), queue base (ms), priority
SLICE_FACTS = [
    ("eMBB", 1, 100.0, 5.0, 1.0),
    ("URLLC", 2, 10.0, 1.0, 3.0),
    ("mMTC", 3, 1.0, 10.0, 0.5),
]

WEIGHT_THROUGHPUT = 0.6
WEIGHT_LOSS = 0.4
DEFAULT_CURVE = (5.0, 1.0)
NO_DATA_LOAD = 0.1
RELAXED_MMTC_LATENCY = 300.0
HISTORY = 60
HORIZON = 15
LOOKAHEAD = 15
TRAIN_RATIO = 0.80

# order in which scenarios are reported
SCENARIO_ORDER = [
    "NormalLoad", "LowTrafficNight", "FifaWorldCup_Commerce", "KddiOutage_Storm",
    "SilverScrapes_Gaming", "ClashLaunch_Sync", "OverloadeMBB_Commerce",
    "OverloadURRLC_Industrie", "IoTStorm_Industrie", "GlobalSaturation",
    "SLABoundary_URLLC", "HetLoad_Asymmetric_A", "HetLoad_Asymmetric_B",
    "HetLoad_Asymmetric_C", "HetLoad_FullDiversity", "RampUp_Commerce",
    "FlashCrowd_Macro", "PostEvent_Recovery", "MECShared_Stress",
    "EmergencyTraffic_URLLC",
]
# ---- end of fixed values ----------------------------------------------------------


def sql_literal(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def inline_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A literal table. It is a LocalRelation, so its exact size is known to the planner,
    which broadcasts it by the ordinary threshold test without a hint."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def unit_dim(spark: SparkSession) -> DataFrame:
    """(gnb, slice) facts: default units, rate, floor, fixed loss curve, budget, capacity."""
    budget = dict(BUDGETS)
    rows = [r + (budget[r[0]],) for r in UNITS]
    return (inline_table(spark, ["gnb", "slice", "units_default", "unit_rate", "units_floor",
                                 "curve_k", "curve_rho", "budget"], rows)
            .withColumn("capacity", F.col("units_default") * F.col("unit_rate")))


def limit_dim(spark: SparkSession, profile: str) -> DataFrame:
    rows = [r[1:] for r in LIMITS if r[0] == profile]
    return inline_table(spark, ["slice", "thr_min", "lat_max", "loss_max"], rows)


def slice_dim(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ["slice", "slice_rank", "queue_capacity", "queue_base", "priority"],
                        SLICE_FACTS)


def unit_grid() -> Column:
    """All (gnb, slice) pairs as one literal array, to be exploded onto each key row."""
    return F.array(*[F.struct(F.lit(r[0]).alias("gnb"), F.lit(r[1]).alias("slice"))
                     for r in UNITS])
