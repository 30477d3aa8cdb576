"""Raw samples to one KPI row per (run, slice, cell, tick)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.functions import scalars as S
from slicewise.operators.series import CHUNK, over_frames, with_positions

RUN_KEYS = ["run", "scenario", "slice", "gnb"]


def kpi_buckets(samples: DataFrame, width: float = 1.0, delay_scale: float = 1000.0) -> DataFrame:
    """Per-bucket means, sums and counts in one aggregation.

    Spark combines map-side, so a bucket that holds most of the samples still shuffles one
    partial row per map task. A bucket exists for every sample, whatever its signal.
    Means are kept to 9 decimals, which makes later threshold tests independent of row order.
    """
    sig, v = F.col("signal"), F.col("v")

    def pick(*tokens: str) -> Column:
        return F.when(_any(sig, tokens), v)

    delay = pick("cbrFrameDelay") * delay_scale
    jitter = pick("cbrJitter") * delay_scale
    rate = pick("cbrReceivedThroughput", "cbrGeneratedThroughput") / 1e6
    tick = (F.col("t") / F.lit(float(width))).cast("bigint").alias("tick")
    return samples.groupBy(*RUN_KEYS, tick).agg(
        F.round(F.avg(delay), 9).alias("mean_delay_ms"),
        F.round(F.avg(jitter), 9).alias("mean_jitter_ms"),
        F.round(F.avg(rate), 9).alias("mean_thr_mbps"),
        F.coalesce(F.sum(pick("cbrReceivedBytes")), F.lit(0.0)).alias("bytes_received"),
        F.count(pick("cbrRcvdPkt")).alias("packets_received"),
        F.count(pick("cbrSentPkt")).alias("packets_sent"))


def _any(sig: Column, tokens: tuple[str, ...]) -> Column:
    cond = sig.contains(tokens[0])
    for token in tokens[1:]:
        cond = cond | sig.contains(token)
    return cond


def kpi_formulas(buckets: DataFrame, width: float = 1.0, noise: float = 0.0,
                 seed: int = 42) -> DataFrame:
    """Throughput, latency, loss, load and service-level flag of each bucket. Jitter is still
    the measured mean and null where nothing was measured."""
    spark = buckets.sparkSession
    facts = dims.slice_dim(spark).join(dims.limit_dim(spark, "detect"), "slice")
    b = buckets.join(facts, "slice")
    thr = (F.when(F.col("bytes_received") > 0, F.col("bytes_received") * 8 / 1e6 / width)
           .otherwise(F.coalesce("mean_thr_mbps", F.lit(0.0))))
    b = b.withColumn("thr", thr)
    queue = S.queue_latency(F.col("thr"), F.col("queue_capacity"), F.col("queue_base"))
    if noise:
        queue = F.greatest(F.lit(0.1), queue + F.randn(seed) * F.col("queue_base") * noise)
    sent, rcvd = F.col("packets_sent"), F.col("packets_received")
    b = b.withColumns({
        "lat": F.coalesce("mean_delay_ms", queue),
        "lat_source": F.when(F.col("mean_delay_ms").isNotNull(), "measured")
        .otherwise("estimated"),
        "loss": F.when(sent > 0, F.greatest(F.lit(0.0), 100.0 * (1.0 - rcvd / sent)))
        .otherwise(F.lit(0.0)),
        "load": F.least(F.lit(100.0),
                        F.col("thr") / F.greatest(F.col("thr_min") * 10, F.lit(1.0)) * 100),
    })
    ok = (F.col("lat") <= F.col("lat_max")) & (F.col("loss") <= F.col("loss_max"))
    return b.withColumn("sla_ok", ok).select(
        *RUN_KEYS, "tick", "thr", "lat", "lat_source", "mean_jitter_ms", "loss", "load",
        "packets_received",
        "thr_min", "lat_max", "loss_max", "sla_ok")


def fill_jitter(kpi: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Jitter where it was not measured: spread of the last five latencies of the run."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        last5 = w.rowsBetween(-4, Window.currentRow)
        spread = F.coalesce(F.stddev_samp("lat").over(last5), F.lit(0.0))
        return {"jit": F.coalesce("mean_jitter_ms", spread)}

    placed = with_positions(kpi, RUN_KEYS, chunk=chunk)
    return (over_frames(placed, RUN_KEYS, "pos", cols, before=4, chunk=chunk)
            .drop("mean_jitter_ms", "packets_received", "pos", "series_len"))


def label_ahead(kpi: DataFrame, ticks: int = dims.LOOKAHEAD, chunk: int = CHUNK) -> DataFrame:
    """Will the service level hold during the next ``ticks`` ticks (this one excluded)?
    Nothing ahead counts as held. Labels never cross runs."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        ahead = F.min(F.col("sla_ok").cast("int")).over(w.rangeBetween(1, ticks))
        return {"ok_ahead": F.coalesce(ahead, F.lit(1)) == 1}

    out = over_frames(kpi, RUN_KEYS, "tick", cols, after=ticks, chunk=chunk)
    return out.withColumn("violated_ahead", F.when(F.col("ok_ahead"), 0).otherwise(1))


def label_ahead_rows(kpi: DataFrame, keys: list[str], rows: int = dims.LOOKAHEAD,
                     chunk: int = CHUNK) -> DataFrame:
    """Row-based label: this row and the ``rows - 1`` following ones. Needs ``pos``."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        ahead = F.min(F.col("sla_ok").cast("int")).over(w.rowsBetween(0, rows - 1))
        return {"ok_ahead": ahead == 1}

    out = over_frames(kpi, keys, "pos", cols, after=rows - 1, chunk=chunk)
    return out.withColumn("violated_ahead", F.when(F.col("ok_ahead"), 0).otherwise(1))


def rounded(kpi: DataFrame) -> DataFrame:
    """Measures to the 6 decimals in which the KPI table is published."""
    have = [c for c in ["thr", "lat", "jit", "loss", "load"] if c in kpi.columns]
    return kpi.withColumns({c: F.round(c, 6) for c in have})


def sla_summary(kpi: DataFrame) -> DataFrame:
    """Rows, violation share, mean latency and measured rows per slice and cell."""
    return kpi.groupBy("slice", "gnb").agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg("violated_ahead") * 100, 6).alias("violation_pct"),
        F.round(F.avg("lat"), 6).alias("mean_latency_ms"),
        F.count(F.when(F.col("lat_source") == "measured", 1)).alias("n_measured"))


def run_duration(samples: DataFrame) -> DataFrame:
    return samples.groupBy("run").agg(F.max("t").alias("max_time"))
