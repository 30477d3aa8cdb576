"""Queries over the live stream, and their batch twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.operators import closed_loop as CL
from slicewise.operators import live as L
from slicewise.operators import report as R
from slicewise.operators.joins import join_groups
from slicewise.operators.profile import r6
from slicewise.operators.series import over_frames, with_positions
from slicewise.plans.etl import SERIES, kpi_base, long_kpi
from slicewise.plans.profiling import block_scenario
from slicewise.plans.registry import query
from slicewise.sinks.documents import allocation_document, default_units
from slicewise.sinks.tables import landed
from slicewise.sources import fixtures as X
from slicewise.streaming import live as SL
from slicewise.streaming import replay as RP

CUTS = [0, 40, 80]              # a new set of files arrives at every tick but the first
LONG_CUTS = [0, 800, 1600]


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(X.live_rows(kpi_base(spark, sf_dir)), "live")


def arrivals(rows: DataFrame, cuts: list[int]) -> list[DataFrame]:
    """The rows in the order of their arrival, one DataFrame per set of files."""
    t = F.col("simtime_s")
    ends = [None, *cuts[1:], None]
    return [rows.filter((F.lit(True) if a is None else t >= a) & (F.lit(True) if b is None else t < b))
            for a, b in zip(ends, ends[1:])]


def long_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = X.lineitem_kpi(spark, sf_dir).withColumn("packets_received", F.lit(1))
    return landed(X.live_rows(k), "live")


@query
def reactive_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = L.reactive_loads(kpi_base(spark, sf_dir), ["scenario"])
    return r.select(*SERIES, "last_tick", r6(F.col("rho")).alias("rho"))


@query
def predictive_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario cut at 75 ticks: the second part is too short and takes the warm-up branch."""
    k = kpi_base(spark, sf_dir).withColumn("scenario", block_scenario(75))
    p = L.fill_missing(L.predictive_loads(k, ["scenario"]), ["scenario"])
    return p.select(*SERIES, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "mode",
                    r6(F.col("p_viol")).alias("p_viol"), r6(F.col("rho")).alias("rho"))


@query
def live_stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = RP.replay(spark, arrivals(live(spark, sf_dir), CUTS), RP.to_files, fmt="csv")
    return spark.read.parquet(out).groupBy(*SERIES).agg(
        F.count("*").alias("n_rows"), F.max("simtime_s").alias("last_time"),
        F.round(F.avg("avg_latency_ms"), 9).alias("mean_lat"), F.sum("pkt_count").alias("packets"))


@query
def live_tail_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric file as its source writes it, row by row, followed while it grows; each time the
    query looks, the last line is torn. Every row as it was read, in the batch that read it."""
    rows = live(spark, sf_dir).orderBy("simtime_s", "scenario", "gnb", "slice")
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in rows.columns])
    text = ",".join(rows.columns) + "\n" + "".join(r[0] + "\n" for r in rows.select(line).toLocalIterator())
    body = text.encode()
    at = [0, len(body) // 3 + 7, 2 * len(body) // 3 + 3, len(body)]
    out = RP.follow(spark, [body[a:b] for a, b in zip(at, at[1:])], rows.schema, RP.to_files)
    return spark.read.parquet(out).select(*SERIES, "simtime_s", "avg_latency_ms", "throughput_mbps", "pkt_count", "pkt_loss_pct")


@query
def stream_tumbling_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished periods only; a last set of files repeats old rows, which come too late."""
    rows = live(spark, sf_dir)
    late = rows.filter(F.col("simtime_s") < 10)
    out = RP.replay(spark, [*arrivals(rows, CUTS), late],
                    lambda s, o: RP.to_files(SL.tumbling_kpi(s), o))
    return spark.read.parquet(out).select(*SERIES, "period_start", "n_rows",
                                          r6(F.col("lat")).alias("lat"),
                                          r6(F.col("thr")).alias("thr"))


@query
def stream_history_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = RP.replay(spark, arrivals(live(spark, sf_dir), CUTS),
                    lambda s, o: RP.to_files(SL.history(s), o))
    return spark.read.parquet(out).select(*SERIES, "last_tick", "n_rows", "ready",
                                          F.round("lat_history", 9).alias("lat_history"))


@query
def stream_reactive_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = RP.replay(spark, arrivals(live(spark, sf_dir), CUTS),
                    lambda s, o: RP.to_files(SL.with_reactive_load(SL.history(s)), o))
    return spark.read.parquet(out).select(*SERIES, "last_tick", r6(F.col("rho")).alias("rho"))


def published(spark: SparkSession, rows: DataFrame, allocate, cuts: list[int] = CUTS) -> DataFrame:
    """One document per cell and finished period."""
    out = RP.replay(spark, arrivals(rows, cuts), lambda s, o: RP.to_batches(
        SL.periodic_fits(s), o, allocate))
    return spark.read.parquet(out).select("scenario", "gnb", "document", "period_end")


@query
def stream_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the reactive controller, and the default one of all cells before them."""
    rows = live(spark, sf_dir)
    first = allocation_document(default_units(rows, ["scenario"]), ["scenario"])
    return published(spark, rows, SL.allocate_reactive).unionByName(first.select(
        "scenario", F.lit("*").alias("gnb"), "document", F.lit(-1).cast("bigint").alias("period_end")))


@query
def stream_predictive_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the predictive controller."""
    return published(spark, live(spark, sf_dir), SL.allocate_predictive)


@query
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = RP.replay(spark, arrivals(live(spark, sf_dir), CUTS), lambda s, o: RP.to_batches(
        SL.latest(s), o))
    lim = dims.limit_dim(spark, "control").select("slice", "lat_max")
    newest = spark.read.parquet(out).groupBy(*SERIES).agg(F.max_by(
        F.struct("avg_latency_ms", "throughput_mbps", "pkt_count"), "simtime_s").alias("r"),
        F.max("simtime_s").alias("simtime_s"))
    return newest.join(lim, "slice").select(
        *SERIES, "simtime_s", "r.*", (F.col("r.avg_latency_ms") <= F.col("lat_max"))
        .alias("sla_ok"))


def learned(spark: SparkSession, sf_dir: str) -> str:
    return RP.replay(spark, arrivals(long_live(spark, sf_dir), LONG_CUTS),
                     lambda s, o: RP.to_files(SL.online_learning(s), o))


LOOP_RATE = 0.01        # the loop's learner starts from zero and not from a trained network


def learned_together(spark: SparkSession, sf_dir: str) -> str:
    return RP.replay(spark, arrivals(long_live(spark, sf_dir), LONG_CUTS),
                     lambda s, o: RP.to_files(SL.federated_learning(s, LOOP_RATE), o))


def online_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed loop whose forecasts come from the weights the stream had learned by then, with the
    averages over the cells flowing back into the learners."""
    k = long_kpi(spark, sf_dir)
    steps = spark.read.parquet(learned_together(spark, sf_dir))
    windows = landed(CL.online_windows(CL.eval_rows(with_positions(k, SERIES), k)), "windows")
    loads = landed(CL.online_loads(CL.with_last_step(windows, steps)), "online")
    return CL.run_online_loop(loads)


@query
def closed_loop_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online_loop(spark, sf_dir)


@query
def sla_reduction_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.sla_reduction(online_loop(spark, sf_dir), online=True)


@query
def half_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error, gain and training loss of the online loop by halves."""
    return R.half_comparison(landed(online_loop(spark, sf_dir), "loop"), ("mae_pred", "gain_pct", "train_loss"))


@query
def rolling_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rolling_quality(landed(online_loop(spark, sf_dir), "loop"))


@query
def stream_replay_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the replay buffer after each finished period and the mean of the newest eight."""
    return spark.read.parquet(learned(spark, sf_dir)).select(
        *SERIES, "period", "n_buffer", "ready",
        r6(F.when(~F.isnan("batch_lat_log"), F.col("batch_lat_log"))).alias("batch_lat_log"))


def online_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(learned(spark, sf_dir)).filter("step > 0")


@query
def online_loss_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing mean of the last five training losses per series."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        return {"loss_5": F.round(F.avg("loss").over(w.rowsBetween(-4, 0)), 9)}
    out = over_frames(online_steps(spark, sf_dir), SERIES, "step", cols, before=4)
    return out.select(*SERIES, "step", "loss_5")


@query
def online_loss_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean training loss of the first and second half and of the first and last 20 steps."""
    u = online_steps(spark, sf_dir)
    n = u.groupBy(*SERIES).agg(F.max("step").alias("n_steps"))
    s, last = F.col("step"), F.col("n_steps")
    mid = F.floor(last / 2)

    def mean(cond: Column, name: str) -> Column:
        return F.round(F.avg(F.when(cond, F.col("loss"))), 9).alias(name)
    return join_groups(u, n, SERIES).groupBy(*SERIES, "n_steps").agg(
        mean(s <= mid, "first_half"), mean(s > mid, "second_half"),
        mean(s <= 20, "first_20"), mean(s > last - 20, "last_20"))


@query
def stream_online_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = spark.read.parquet(learned(spark, sf_dir)).filter("ready")
    return u.select(*SERIES, "period", "step", F.round("loss", 9).alias("loss"),
                    F.round(F.col("w")[0], 12).alias("w0"), F.round(F.col("w")[1], 12).alias("w1"),
                    F.round(F.col("w")[2], 12).alias("w2"))


@query
def stream_federated_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter averages published while the stream learns."""
    out = RP.replay(spark, arrivals(long_live(spark, sf_dir), LONG_CUTS),
                    lambda s, o: RP.to_batches(SL.online_learning(s), o))
    return SL.federated_rounds(spark.read.parquet(out)).select(
        "scenario", "slice", "step", F.col("idx").cast("bigint").alias("idx"),
        F.round("value", 12).alias("value"), "n_cells")


@query
def stream_federated_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning steps of all cells where the averages flow back into the learners."""
    return spark.read.parquet(learned_together(spark, sf_dir)).select(
        *SERIES, "period", "step", "fedavg", F.round("loss", 6).alias("loss"),
        *[F.round(F.col("w")[i], 8).alias(f"w{i}") for i in range(3)])
