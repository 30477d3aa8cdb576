"""Multi-step forecasts from a history of 60 rows, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.operators.features import TARGETS
from slicewise.operators.profile import correlation
from slicewise.operators.series import CHUNK, over_frames

CENTRE = (dims.HISTORY + 1) / 2      # distance from the middle of the history to step 0


def ahead(target: str, h: Column) -> Column:
    """Value of the fitted line ``h`` steps after the history (first step is 0)."""
    return F.col(f"mean_{target}") + F.col(f"slope_{target}") * (h + CENTRE)


def steps() -> Column:
    return F.sequence(F.lit(0), F.lit(dims.HORIZON - 1))


def trend_forecast(series: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """Straight-line forecast of every row with a full history behind it: one row per step."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        hist = w.rowsBetween(-(dims.HISTORY - 1), 0)
        out = {}
        for t in TARGETS:
            out[f"mean_{t}"] = F.round(F.avg(t).over(hist), 9)
            out[f"slope_{t}"] = F.round(F.regr_slope(t, "pos").over(hist), 9)
        return out
    fit = (over_frames(series, keys, "pos", cols, before=dims.HISTORY - 1, chunk=chunk)
           .filter(F.col("pos") >= dims.HISTORY - 1))
    rows = fit.withColumn("h", F.explode(steps()))
    return rows.select(*keys, "pos", (F.col("h") + 1).cast("bigint").alias("step"),
                       ahead("thr", F.col("h")).alias("thr_pred"),
                       F.expm1(ahead("lat_log", F.col("h"))).alias("lat_pred"),
                       ahead("loss", F.col("h")).alias("loss_pred"))


def window_fits(eval_rows: DataFrame, keys: list[str], more: tuple[Column, ...] = ()) -> DataFrame:
    """Line fits of each evaluation window's history and the late share of its observation,
    by one aggregation with map-side combine. ``eval_rows`` carries ``late`` and the targets;
    ``more`` are further aggregates of a window's rows."""
    past, seen = F.col("h") < 0, F.col("h") >= 0
    aggs = [F.round(F.avg(F.when(seen, F.col("late"))), 9).alias("p_real")]
    for t in TARGETS:
        y = F.when(past, F.col(t))
        aggs.append(F.round(F.avg(y), 9).alias(f"mean_{t}"))
        aggs.append(F.round(F.regr_slope(y, "h"), 9).alias(f"slope_{t}"))
    return eval_rows.groupBy(*keys, "t").agg(*aggs, *more)


def late_share(limit: Column) -> Column:
    """Share of forecast steps whose latency is over the limit."""
    return F.size(F.filter(steps(), lambda h: F.expm1(ahead("lat_log", h)) > limit)) / dims.HORIZON


def mean_over_steps(target: str) -> Column:
    """Mean of a linear forecast over the horizon: its value in the middle."""
    return ahead(target, F.lit((dims.HORIZON - 1) / 2))


def mean_latency_ahead() -> Column:
    total = F.aggregate(steps(), F.lit(0.0), lambda acc, h: acc + F.expm1(ahead("lat_log", h)))
    return total / dims.HORIZON


def observed() -> Column:
    """Aggregate of a window's rows: its observation, an array of the 15 steps in order."""
    return F.sort_array(F.collect_list(F.when(F.col("h") >= 0, F.struct("h", "thr", "lat_log", "loss")))).alias("seen")


def trend_steps() -> Column:
    """The 15 steps of a window's line fits: h, thr, lat (ms), loss."""
    return F.transform(steps(), lambda h: F.struct(
        h.alias("h"), ahead("thr", h).alias("thr"), F.expm1(ahead("lat_log", h)).alias("lat"), ahead("loss", h).alias("loss")))


def window_scores(windows: DataFrame, pred: Column, keys: list[str], limits: DataFrame) -> DataFrame:
    """Errors and violation decisions of each window: mean latency or mean loss over limit. The
    forecast ``pred`` and the observation ``seen`` are arrays of the window's row."""
    percent = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    both = F.zip_with(pred, "seen", lambda p, s: F.struct(
        p["lat"].alias("p_lat"), percent(p["loss"]).alias("p_loss"), F.expm1(s["lat_log"]).alias("t_lat"),
        percent(s["loss"]).alias("t_loss"), F.abs(p["thr"] - s["thr"]).alias("e_thr")))
    mean = lambda f: F.aggregate("_both", F.lit(0.0), lambda a, x: a + f(x)) / F.size("_both")
    w = windows.withColumn("_both", both).select(
        *keys, "t", mean(lambda x: F.abs(x["p_lat"] - x["t_lat"])).alias("e_lat"),
        mean(lambda x: F.abs(x["p_loss"] - x["t_loss"])).alias("e_loss"), mean(lambda x: x["e_thr"]).alias("e_thr"),
        *[F.round(mean(lambda x, c=c: x[c]), 9).alias(c) for c in ("p_lat", "p_loss", "t_lat", "t_loss")])
    w = w.join(limits.select("slice", "lat_max", "loss_max"), "slice")
    return w.withColumns({
        f"{who}_viol": (F.col(f"{who}_lat") > F.col("lat_max"))
        | (F.col(f"{who}_loss") > F.col("loss_max")) for who in ("p", "t")})


def forecast_metrics(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean errors, confusion counts and the usual ratios (0 where undefined, but null
    specificity without negatives)."""
    p, t = F.col("p_viol"), F.col("t_viol")

    def n(cond: Column, name: str) -> Column:
        return F.count(F.when(cond, 1)).alias(name)
    m = scores.groupBy(*by).agg(
        F.round(F.avg("e_lat"), 5).alias("mae_lat_ms"),
        F.round(F.avg("e_loss"), 5).alias("mae_loss_pct"),
        F.round(F.avg("e_thr"), 5).alias("mae_thr_mbps"),
        n(p & t, "tp"), n(~p & ~t, "tn"), n(p & ~t, "fp"), n(~p & t, "fn"),
        F.round(F.avg(t.cast("double")), 6).alias("viol_rate"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    zero = F.lit(0.0)
    return m.withColumns({
        "precision": F.round(F.coalesce(ratio(tp, tp + fp), zero), 6),
        "recall": F.round(F.coalesce(ratio(tp, tp + fn), zero), 6),
        "f1": F.round(F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero), 6),
        "specificity": F.round(ratio(tn, tn + fp), 6)})


def prediction_quality(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Correlation and mean error of predicted and observed late shares; null with ten or
    fewer pairs or no spread."""
    q = pairs.dropna(subset=["p_pred", "p_real"]).groupBy(*by).agg(
        F.count("*").alias("n"), correlation(F.col("p_real"), F.col("p_pred")).alias("r"),
        F.avg(F.abs(F.col("p_pred") - F.col("p_real"))).alias("mae"),
        F.stddev_pop("p_real").alias("sd"))
    usable = (F.col("n") > 10) & (F.col("sd") > 0)
    clean = F.when(usable, F.round("r", 6))
    return q.select(*by, "n", clean.alias("r"),
                    F.when(usable, F.round("mae", 6)).alias("mae"))


def supervised(series: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """Rows with a full horizon ahead and, as ``y_<target>``, the mean of each target over it."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        future = w.rowsBetween(1, dims.HORIZON)
        return {f"y_{t}": F.avg(t).over(future) for t in TARGETS}
    out = over_frames(series, keys, "pos", cols, after=dims.HORIZON, chunk=chunk)
    return out.filter(F.col("pos") < F.col("series_len") - dims.HORIZON)
