"""Reports over allocation, loop and mode results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.operators.profile import r6, share
from slicewise.operators.quantiles import exact_quantiles
from slicewise.operators.series import CHUNK, over_frames, running_sums


# ---- control modes ----------------------------------------------------------------

def with_control_limits(kpi: DataFrame) -> DataFrame:
    lim = dims.limit_dim(kpi.sparkSession, "control").select(
        "slice", F.col("lat_max").alias("c_lat"), F.col("loss_max").alias("c_loss"))
    return kpi.join(lim, "slice")


def mode_kpis(kpi: DataFrame) -> DataFrame:
    """Latency, throughput and violation figures per mode and slice."""
    bad = (F.col("lat") > F.col("c_lat")) | (F.col("loss") > F.col("c_loss"))
    m = with_control_limits(kpi).groupBy("mode", "slice").agg(
        r6(F.avg("lat")).alias("mean_lat_ms"), r6(F.avg("thr")).alias("mean_thr_mbps"),
        share(bad).alias("viol_rate_pct"), F.count("*").alias("n_windows"))
    p = exact_quantiles(kpi, ["mode", "slice"], F.col("lat"), {"p95_lat_ms": 0.95})
    return m.join(p.withColumn("p95_lat_ms", r6(F.col("p95_lat_ms"))), ["mode", "slice"])


def mode_gain(kpis: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Improvement of each mode over the baseline, per slice."""
    base = kpis.filter(F.col("mode") == baseline).select(
        "slice", F.col("viol_rate_pct").alias("b_viol"), F.col("mean_lat_ms").alias("b_lat"))
    return kpis.filter(F.col("mode") != baseline).join(base, "slice").select(
        "mode", "slice", F.round(F.col("b_viol") - F.col("viol_rate_pct"), 6).alias("gain_viol_pp"),
        F.round(F.col("b_lat") - F.col("mean_lat_ms"), 6).alias("gain_lat_ms"))


def cumulative_violation(kpi: DataFrame, chunk: int = 60) -> DataFrame:
    """Expanding share of late rows per mode and slice. A tick holds the rows of all runs and
    cells of a mode, so the chunks are short."""
    late = (F.col("lat") > F.col("c_lat")).cast("bigint")
    out = running_sums(with_control_limits(kpi), ["mode", "slice"], "tick",
                       {"late_so_far": late, "rows_so_far": F.lit(1).cast("bigint")},
                       ("scenario", "gnb"), chunk)
    return out.select("mode", "slice", "tick", "scenario", "gnb",
                      r6(F.col("late_so_far") / F.col("rows_so_far") * 100).alias("cum_viol_pct"))


# ---- loop results -----------------------------------------------------------------

def with_global_order(loop: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Row number in the order (scenario, cell, window), overall or within the given keys.

    Windows of a cell are contiguous, so the number is the count of all windows of earlier
    cells plus the window's own index; only the table of cells is ordered.
    """
    order = [c for c in ("scenario", "gnb") if c not in within]
    cells = loop.groupBy("scenario", "gnb").agg(F.count("*").alias("_n"), F.min("t").alias("_t0"))
    w = Window.partitionBy(*within).orderBy(*order)
    cells = cells.withColumns({
        "_before": F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                              F.lit(0)),
        "n_all": F.sum("_n").over(Window.partitionBy(*within))})
    return (loop.join(cells, ["scenario", "gnb"])
            .withColumn("row_no", F.col("_before") + F.floor((F.col("t") - F.col("_t0"))
                                                             / dims.HORIZON))
            .drop("_n", "_t0", "_before"))


def half_comparison(loop: DataFrame, measures: tuple[str, ...] = ("mae_pred", "gain_pct"),
                    edge: int = 20) -> DataFrame:
    """Means of the first and second half and of the first and last rows."""
    o = with_global_order(loop)
    mid = F.floor(F.col("n_all") / 2)
    parts = {"first_half": F.col("row_no") < mid, "second_half": F.col("row_no") >= mid,
             "first_rows": F.col("row_no") < edge,
             "last_rows": F.col("row_no") >= F.col("n_all") - edge}
    one = o.agg(*[F.round(F.avg(F.when(cond, F.col(m))), 5).alias(f"{p}|{m}")
                  for p, cond in parts.items() for m in measures])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("part"), *[F.col(f"`{p}|{m}`").alias(m) for m in measures])
        for p in parts])).alias("r")).select("r.*")


def rolling_quality(loop: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Trailing means of ten (error, gain) and five (objective) windows per cell."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        ten, five = w.rowsBetween(-9, 0), w.rowsBetween(-4, 0)
        return {"mae_10": F.round(F.avg("mae_pred").over(ten), 8),
                "gain_10": F.round(F.avg("gain_pct").over(ten), 8),
                "objective_5": F.round(F.avg("F_optimal").over(five), 8)}
    o = with_global_order(loop, ("gnb",)).withColumn("row_no", F.col("row_no").cast("bigint"))
    out = over_frames(o, ["gnb"], "row_no", cols, before=9, chunk=chunk)
    return out.select("gnb", "scenario", "t", "row_no", "mae_10", "gain_10", "objective_5")


def gain_by_group(report: DataFrame) -> DataFrame:
    """Mean and median gain and the number of nearly free objectives overall, by cell and by
    scenario."""
    rows = report.select("gain_pct", "F_optimal", F.explode(F.array(
        F.struct(F.lit("all").alias("level"), F.lit("*").alias("name")),
        F.struct(F.lit("gnb").alias("level"), F.col("gnb").alias("name")),
        F.struct(F.lit("scenario").alias("level"), F.col("scenario").alias("name")))).alias("g")
    ).select("gain_pct", "F_optimal", "g.*")
    by = ["level", "name"]
    m = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg("gain_pct"), 5).alias("mean_gain"),
        F.count(F.when(F.col("F_optimal") < 0.1, 1)).alias("n_below_0_1"))
    q = exact_quantiles(rows, by, F.col("gain_pct"), {"median_gain": 0.5})
    return m.join(q.withColumn("median_gain", F.round("median_gain", 5)), by)


def nearly_free(report: DataFrame, below: float = 0.1) -> DataFrame:
    """The (scenario, cell) pairs whose objective ends below ``below``."""
    return report.filter(F.col("F_optimal") < below).select(
        "scenario", "gnb", "F_default", "F_optimal", "gain_pct")


def top_scenarios(report: DataFrame, n: int = 10) -> DataFrame:
    """The scenarios with the largest mean gain."""
    return (report.groupBy("scenario").agg(F.round(F.avg("gain_pct"), 5).alias("mean_gain"))
            .orderBy(F.col("mean_gain").desc(), "scenario").limit(n))


def ordered_gain_matrix(report: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Gain and objective per cell, scenarios that exist in the listed order."""
    names = dims.inline_table(report.sparkSession, ["scenario", "position"],
                              [(s, i) for i, s in enumerate(order or dims.SCENARIO_ORDER)])
    m = report.groupBy("scenario").pivot("gnb", dims.CELLS).agg(
        F.round(F.avg("gain_pct"), 5).alias("gain"), F.round(F.avg("F_optimal"), 5).alias("f_opt"))
    return (m.join(names, "scenario")
            .withColumn("position", F.col("position").cast("bigint")).orderBy("position"))


# ---- model scores -----------------------------------------------------------------

def score_recommendations(scores: DataFrame) -> DataFrame:
    """Overall scores, hardest cell and slice, and the level codes of the rule ladder.
    ``scores`` has one row per (slice, gnb) with f1, precision, recall."""
    by_cell = scores.groupBy("gnb").agg(F.round(F.avg("f1"), 6).alias("f1"))
    by_slice = scores.groupBy("slice").agg(F.round(F.avg("f1"), 6).alias("f1"))

    def edges(df: DataFrame, key: str) -> DataFrame:
        return df.agg(F.min(F.struct("f1", key)).alias("w"), F.max("f1").alias("m")).select(
            F.lit(1).alias("one"), F.col(f"w.{key}").alias(f"worst_{key}"),
            F.col("w.f1").alias(f"worst_{key}_f1"),
            F.round(F.col("m") - F.col("w.f1"), 6).alias(f"gap_{key}"))

    one = (scores.agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}")
                        for c in ("f1", "precision", "recall")])
           .withColumn("one", F.lit(1))
           .join(edges(by_cell, "gnb"), "one").join(edges(by_slice, "slice"), "one").drop("one"))
    f1 = F.col("mean_f1")
    commerce = F.col("worst_gnb") == "Commerce"
    return one.withColumns({
        "verdict": F.when(f1 >= 0.65, "OK").when(f1 >= 0.50, "ATTENTION").otherwise("CRITIQUE"),
        "cell_code": F.when(commerce & (F.col("gap_gnb") > 0.20), "COMMERCE")
        .when(commerce & (F.col("gap_gnb") > 0.10), "INFO"),
        "slice_code": F.when((F.col("gap_slice") > 0.20) & (F.col("worst_slice_f1") < 0.60),
                             "SLICE"),
        "balance_code": F.when((F.col("mean_recall") < 0.45) & (f1 < 0.75), "RECALL")
        .when((F.col("mean_precision") < 0.45) & (f1 < 0.75), "PRECISION")})
