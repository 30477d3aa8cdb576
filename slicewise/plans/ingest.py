"""Queries over text logs, CSV files, mode folders and documents. The files are written by
Spark from the given tables into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.operators import kpi as K
from slicewise.operators.profile import r6
from slicewise.plans.control import allocation
from slicewise.plans.etl import kpi_full
from slicewise.plans.registry import query
from slicewise.plans.reports import mode_kpi
from slicewise.session import work_dir
from slicewise.sinks.documents import allocation_document
from slicewise.sources import fixtures as X
from slicewise.sources import kpi_files as KF
from slicewise.sources import signal_log as SL


def write_signal_logs(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Signal logs of every run, one folder of part files per run. Vector ids repeat between
    runs."""
    s = X.raw_samples(spark, sf_dir)
    number = sum(F.when(F.col("signal") == name, i).otherwise(0) for i, name in enumerate(
        ["cbrSentPkt", "cbrRcvdPkt", "cbrReceivedBytes", "cbrFrameDelay", "cbrJitter"]))
    vec = F.concat_ws("", (F.floor(F.col("user_id") / 18)).cast("string"),
                      (F.col("user_id") % 9).cast("string"), number.cast("string"))
    s = s.withColumn("vec_id", vec)
    decl = s.select("run", "vec_id", "module", "signal").distinct().select(
        "run", F.concat(F.lit("vector "), "vec_id", F.lit(" "), "module", F.lit(" "), "signal",
                        F.lit(":vector ETV")).alias("line"))
    data = s.select("run", F.concat_ws("\t", "vec_id", F.col("event_id").cast("string"),
                                       F.col("t").cast("string"), F.col("v").cast("string"))
                    .alias("line"))
    lines = decl.unionByName(data).select("line", F.concat("run", F.lit(".vec")).alias("log"))
    lines.write.partitionBy("log").text(f"{path}/signals")
    return f"{path}/signals"


def write_scalar_logs(spark: SparkSession, sf_dir: str, path: str, only: str | None = None) -> str:
    """Scalar logs of all runs, or of those whose name starts with ``only``."""
    sums = X.raw_samples(spark, sf_dir).groupBy("run", "module", "signal").agg(
        F.count("*").alias("n"))
    lines = sums.select(F.concat("run", F.lit(".sca")).alias("log"), F.concat(
        F.lit("scalar "), "module", F.lit(" "), "signal", F.lit(":count "),
        F.col("n").cast("string")).alias("line"))
    if only:
        lines = lines.filter(F.col("log").startswith(only))
    lines.write.partitionBy("log").text(f"{path}/scalars")
    return f"{path}/scalars"


@query
def scan_signal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = write_signal_logs(spark, sf_dir, work_dir(spark, "logs"))
    decl, samples = SL.land_signal_log(spark, logs)
    d = decl.groupBy("run", "signal").agg(F.count("*").alias("n_vectors"))
    v = SL.attach_keys(samples, decl).groupBy("run", "signal").agg(
        F.count("*").alias("n_samples"), F.round(F.sum("v"), 2).alias("v_sum"),
        r6(F.max("t")).alias("t_max"))
    return d.join(v, ["run", "signal"])


@query
def relevant_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = write_signal_logs(spark, sf_dir, work_dir(spark, "logs"))
    decl, _ = SL.scan_signal_log(spark, logs)
    return SL.relevant_vectors(decl).groupBy("scenario", "slice", "gnb", "signal").agg(
        F.count("*").alias("n_vectors"))


@query
def samples_with_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain from text to buckets: scan, filter, join, aggregate."""
    logs = write_signal_logs(spark, sf_dir, work_dir(spark, "logs"))
    decl, samples = SL.land_signal_log(spark, logs, only_relevant=True)
    keyed = SL.attach_keys(samples, SL.relevant_vectors(decl))
    b = K.kpi_buckets(keyed, delay_scale=1.0)
    return b.select(*K.RUN_KEYS, "tick", "mean_delay_ms", "mean_jitter_ms", "bytes_received",
                    "packets_received", "packets_sent")


@query
def scan_scalar_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = write_scalar_logs(spark, sf_dir, work_dir(spark, "logs"))
    return SL.scalar_totals(SL.scan_scalar_log(spark, logs))


@query
def run_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "logs")
    write_signal_logs(spark, sf_dir, path)
    write_scalar_logs(spark, sf_dir, path, "S0")      # S1 runs lack their companion file
    c = SL.run_catalog(spark, path)
    return c.select("run", "scenario", "has_scalars")


@query
def kpi_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "kpi_csv")
    KF.write_kpi_csv(kpi_full(spark, sf_dir), path)
    return KF.read_kpi_csv(spark, path).drop("ts")


@query
def kpi_export_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KF.kpi_export(kpi_full(spark, sf_dir))


@query
def modes_union_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "modes")
    k = mode_kpi(spark, sf_dir)
    KF.write_modes(X.live_rows(k, "mode"), path)
    m = KF.read_modes(spark, path)
    return m.groupBy("mode", "slice").agg(
        F.count("*").alias("n"), r6(F.avg("avg_latency_ms")).alias("mean_lat_ms"),
        F.sum("pkt_count").alias("packets"))


@query
def allocation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = allocation(spark, sf_dir)
    units = a.select("scenario", "gnb", F.explode(F.array(*[
        F.struct(F.lit(s).alias("slice"), F.col(f"R_{s}_opt").alias("units"))
        for s in ("eMBB", "URLLC", "mMTC")])).alias("u")).select("scenario", "gnb", "u.*")
    return allocation_document(units, ["scenario"])
