"""KPI files, live metric files and mode folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: published column, column of this package, type written
KPI_COLUMNS = [
    ("Time_Sec", None, "string"), ("Slice_Type", "slice", "string"), ("gNB_id", "gnb", "string"),
    ("Scenario", "scenario", "string"), ("Slice_Throughput_Mbps", "thr", "double"),
    ("Slice_Latency_ms", "lat", "double"), ("Slice_Jitter_ms", "jit", "double"),
    ("Slice_Packet_Loss_pct", "loss", "double"), ("Slice_Network_Load_pct", "load", "double"),
    ("SLA_Throughput_Min_Mbps", "thr_min", "double"), ("SLA_Latency_Max_ms", "lat_max", "double"),
    ("SLA_PacketLoss_Max_pct", "loss_max", "double"), ("SLA_OK", "sla_ok", "string"),
    ("SLA_OK_in_15s", "ok_ahead", "string"), ("SLA_Violated_in_15s", "violated_ahead", "int"),
]
KPI_SCHEMA = ", ".join(f"{name} {kind}" for name, _, kind in KPI_COLUMNS)
LIVE_SCHEMA = ("scenario string, simtime_s double, gnb string, slice string, "
               "avg_latency_ms double, throughput_mbps double, pkt_count bigint, "
               "pkt_loss_pct double")
TIME_ZERO = "2024-01-01 00:00:00"


def as_flag(c: Column) -> Column:
    """Flags are written as true/false by one producer and as 1/0 by another."""
    return F.lower(c).isin("true", "1")


def read_kpi_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(KPI_SCHEMA).csv(path, header=True)
    out = {mine: F.col(name) for name, mine, _ in KPI_COLUMNS if mine}
    out |= {"sla_ok": as_flag(F.col("SLA_OK")), "ok_ahead": as_flag(F.col("SLA_OK_in_15s"))}
    ts = F.try_to_timestamp("Time_Sec", F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    return raw.select(ts.alias("ts"),
                      (F.unix_timestamp(ts) - F.unix_timestamp(F.lit(TIME_ZERO))).alias("tick"),
                      *[c.alias(n) for n, c in out.items()])


def kpi_export(kpi: DataFrame) -> DataFrame:
    """The published 15-column form: ISO time with Z, six decimals, lower-case flags, sorted."""
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(TIME_ZERO)) + F.col("tick"))
    cols = [F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Time_Sec")]
    for name, mine, kind in KPI_COLUMNS[1:]:
        c = F.round(mine, 6) if mine in ("thr", "lat", "jit", "loss", "load") else F.col(mine)
        cols.append(c.cast(kind).alias(name))
    return kpi.select(*cols).orderBy("Time_Sec", "Slice_Type", "gNB_id")


def write_kpi_csv(kpi: DataFrame, path: str) -> None:
    kpi_export(kpi).write.mode("errorifexists").csv(path, header=True)


def read_modes(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of all modes below ``mode=<name>/`` folders; a mode without a folder is simply
    not there."""
    return (spark.read.schema(LIVE_SCHEMA + ", mode string").option("header", "true").csv(path))


def write_modes(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").partitionBy("mode").option("header", "true").csv(path)
