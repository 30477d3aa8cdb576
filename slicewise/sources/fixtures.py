"""The given tables seen as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200          # 2024-01-01 UTC
EVENT_TICK = 21600          # six hours
MODES = ["baseline", "periodic_milp", "lstm_milp"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(index: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal samples: run, scenario, module, signal, vec_id, t (in ticks), v."""
    user, kind = F.col("user_id"), F.col("event_type")
    token = _choose(user % 3, ["Embb", "Urllc", "Mmtc"])
    cell = F.floor(user / 3) % 3
    scenario = F.concat(F.lit("S"), (F.floor(user / 9) % 2).cast("string"))
    signal = (F.when(kind == "click", "cbrSentPkt").when(kind == "view", "cbrRcvdPkt")
              .when(kind == "purchase", "cbrReceivedBytes")
              .when(kind == "error", "cbrFrameDelay").otherwise("cbrJitter"))
    client = F.concat(F.lit("ue"), token, F.lit("_"), _choose(cell, ["A", "B", "C"]),
                      F.lit("["), user.cast("string"), F.lit("].app[0]"))
    server = F.concat(F.lit("server"), token, F.lit(".app["), cell.cast("string"), F.lit("]"))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    v = F.when(kind == "purchase", F.round(F.col("value") * 100000)).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", scenario.alias("scenario"),
        F.concat(scenario, F.lit("-0")).alias("run"),
        _choose(cell, ["Macro", "Commerce", "Industrie"]).alias("gnb"),
        _choose(user % 3, ["eMBB", "URLLC", "mMTC"]).alias("slice"),
        F.when(kind == "click", client).otherwise(server).alias("module"),
        signal.alias("signal"),
        ((seconds - EPOCH) / EVENT_TICK).alias("t"), v.alias("v"))


def keyed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with slice and cell, as the log scan delivers them after its join."""
    return raw_samples(spark, sf_dir)


def mode_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of three control modes; the mode takes the place of the run."""
    mode = _choose(F.col("event_id") % 3, MODES)
    return (keyed_samples(spark, sf_dir).withColumn("run", mode))


def lineitem_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long KPI series: one tick per day."""
    flag, supp = F.col("l_returnflag"), F.col("l_suppkey")
    days = F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date"))
    li = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("L"), (F.col("l_linenumber") % 2).cast("string")).alias("scenario"),
        _choose(supp % 3, ["Macro", "Commerce", "Industrie"]).alias("gnb"),
        F.when(flag == "A", "eMBB").when(flag == "N", "URLLC").otherwise("mMTC").alias("slice"),
        days.cast("bigint").alias("tick"),
        F.col("l_quantity").alias("q"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("bytes"),
        F.when(F.col("l_linestatus") == "F", 100.0).otherwise(0.0).alias("lost"))
    return li.groupBy("scenario", "gnb", "slice", "tick").agg(
        F.round(F.sum("bytes") * 8 / 1e6, 6).alias("thr"),
        F.round(F.avg("q"), 6).alias("lat"),
        F.round(F.avg("lost"), 6).alias("loss"))


def param_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parameter vector with its slice and cell, in the order of ``vec_id``."""
    return table(spark, sf_dir, "embeddings").select(
        _choose(F.col("label") % 3, ["eMBB", "URLLC", "mMTC"]).alias("slice"),
        _choose(F.col("vec_id") % 3, ["Macro", "Commerce", "Industrie"]).alias("gnb"),
        "vec_id", "embedding")


def param_name(idx: Column) -> Column:
    return F.concat(F.lit("p"), F.floor(idx / 16).cast("string"))


def model_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last parameter vector per (slice, cell), long form."""
    ends = param_vectors(spark, sf_dir).groupBy("slice", "gnb").agg(
        F.min_by("embedding", "vec_id").alias("initial"),
        F.max_by("embedding", "vec_id").alias("final"))
    rows = ends.select("slice", "gnb", F.posexplode(F.arrays_zip("initial", "final"))
                       .alias("idx", "pair"))
    return rows.select(
        "slice", "gnb",
        param_name(F.col("idx")).alias("param"),
        F.col("idx").cast("bigint").alias("idx"),
        F.col("pair.initial").cast("double").alias("initial"),
        F.col("pair.final").cast("double").alias("final"))


def live_rows(kpi: DataFrame, *more: str) -> DataFrame:
    """KPI rows in the shape of the live metric stream; one tick is one second."""
    return kpi.select(
        *more, "scenario", F.col("tick").cast("double").alias("simtime_s"), "gnb", "slice",
        F.col("lat").alias("avg_latency_ms"), F.col("thr").alias("throughput_mbps"),
        F.col("packets_received").cast("bigint").alias("pkt_count"),
        F.col("loss").alias("pkt_loss_pct"))
