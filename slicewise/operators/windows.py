"""Sliding sequence windows, temporal split and evaluation windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.operators.joins import join_groups
from slicewise.operators.series import CHUNK, over_frames

X_ROWS, Y_ROWS = dims.HISTORY, dims.HORIZON


def _is_window_end() -> Column:
    """Last row of a history: the start runs over 0 .. length - X - Y - 1."""
    start = F.col("pos") - (X_ROWS - 1)
    return (start >= 0) & (start < F.col("series_len") - (X_ROWS + Y_ROWS))


def sequence_windows(series: DataFrame, keys: list[str], x_cols: list[str], y_cols: list[str],
                     chunk: int = CHUNK) -> DataFrame:
    """One row per sliding window with its history ``x`` and its future ``y`` as arrays of
    structs. Multiplies the data by the window length: meant for export to training."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        return {"x": F.collect_list(F.struct(*x_cols)).over(w.rowsBetween(-(X_ROWS - 1), 0)),
                "y": F.collect_list(F.struct(*y_cols)).over(w.rowsBetween(1, Y_ROWS))}
    out = over_frames(series, keys, "pos", cols, before=X_ROWS - 1, after=Y_ROWS, chunk=chunk)
    return (out.filter(_is_window_end())
            .select(*keys, (F.col("pos") - (X_ROWS - 1)).alias("start"), "x", "y"))


def window_weights(series: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """Sampling weight of each sliding window: latency spread of its history plus one."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        return {"weight": F.stddev_pop("lat").over(w.rowsBetween(-(X_ROWS - 1), 0)) + 1.0}
    out = over_frames(series, keys, "pos", cols, before=X_ROWS - 1, chunk=chunk)
    return (out.filter(_is_window_end())
            .select(*keys, (F.col("pos") - (X_ROWS - 1)).alias("start"), "weight"))


def series_lengths(kpi: DataFrame, keys: list[str]) -> DataFrame:
    return kpi.groupBy(*keys).agg(F.count("*").alias("series_len"))


def temporal_split(lengths: DataFrame, ratio: float = dims.TRAIN_RATIO,
                   val_share: float = 0.15) -> DataFrame:
    """Start and part (train, val, test) of every sliding window of every series.

    Needs only the series lengths, as windows are counted and not built. Validation is the
    last part of a slice's training windows in the order (scenario, cell, start); the rank is
    the number of windows of earlier series plus the start, so no window row is sorted.
    """
    t = F.col("series_len")
    cut = F.floor(t * F.lit(ratio)).cast("bigint")
    spare = F.lit(X_ROWS + Y_ROWS)
    test_from = F.greatest(F.lit(0), cut - X_ROWS).cast("bigint")
    s = lengths.withColumns({
        "n_train": F.greatest(F.lit(0), cut - spare).cast("bigint"),
        "test_from": test_from,
        "n_test": F.greatest(F.lit(0), t - test_from - spare).cast("bigint")})
    # one row per series: small beside the rows, never a window over the samples
    order = Window.partitionBy("slice").orderBy("scenario", "gnb")
    s = s.withColumns({
        "ahead": F.coalesce(F.sum("n_train").over(
            order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "all_train": F.sum("n_train").over(Window.partitionBy("slice"))})
    n_val = F.greatest(F.lit(1), F.floor(F.col("all_train") * F.lit(val_share))).cast("bigint")

    keys = ["slice", "scenario", "gnb"]

    def starts(rows: DataFrame, n: str, first: Column, *more: str) -> DataFrame:
        """Starts ``first`` to ``first + n - 1``: the pieces of a long series are dealt to all
        tasks before they are written out, so no row holds more than one chunk."""
        pieces = (rows.filter(F.col(n) > 0)
                  .select(*keys, *more, first.alias("_from"), (first + F.col(n)).alias("_to"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / CHUNK))
                                    ).alias("_c"))
                  .repartition(*keys, "_c"))
        low = F.col("_from") + F.col("_c") * CHUNK
        return pieces.select(*keys, *more, F.explode(F.sequence(
            low, F.least(low + CHUNK, F.col("_to")) - 1)).alias("start"))

    train = (starts(s.withColumn("n_val", n_val), "n_train", F.lit(0).cast("bigint"),
                    "ahead", "all_train", "n_val")
             .select(*keys, "start",
                     F.when(F.col("ahead") + F.col("start") >= F.col("all_train") - F.col("n_val"),
                            "val").otherwise("train").alias("part")))
    test = starts(s, "n_test", F.col("test_from")).withColumn("part", F.lit("test"))
    return train.unionByName(test)


def aligned_cells(lengths: DataFrame) -> DataFrame:
    """(scenario, cell) pairs with all three slices long enough, and their common length."""
    long_enough = lengths.filter(F.col("series_len") >= X_ROWS + Y_ROWS)
    return (long_enough.groupBy("scenario", "gnb")
            .agg(F.countDistinct("slice").alias("n_slices"),
                 F.min("series_len").alias("common_len"))
            .filter(F.col("n_slices") == len(dims.SLICES)).drop("n_slices"))


def first_window(common_len: Column) -> Column:
    return F.greatest(F.lit(X_ROWS), F.floor(common_len * F.lit(dims.TRAIN_RATIO))).cast("bigint")


def with_eval_windows(series: DataFrame, aligned: DataFrame) -> DataFrame:
    """Each row once per evaluation window it serves, as history (``h`` in -60..-1) or as
    observation (``h`` in 0..14). ``t`` is the position at which the window starts.

    A row serves at most five windows, so no window partition over the series is needed: all
    later steps are aggregations by (series, t).
    """
    a = aligned.withColumn("t0", first_window(F.col("common_len")))
    j = join_groups(series, a, ["scenario", "gnb"])
    # windows t = t0 + 15 w with t - 60 <= pos < t + 15 and t + 15 <= common length
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - F.col("t0")) / Y_ROWS))
    last = F.least(F.floor((F.col("pos") + X_ROWS - F.col("t0")) / Y_ROWS),
                   F.floor((F.col("common_len") - F.col("t0")) / Y_ROWS) - 1)
    serves = j.withColumns({"_f": first.cast("bigint"), "_l": last.cast("bigint")})
    return (serves.filter(F.col("_l") >= F.col("_f"))
            .withColumn("w", F.explode(F.sequence("_f", "_l")))
            .withColumn("t", F.col("t0") + F.col("w") * Y_ROWS)
            .withColumn("h", F.col("pos") - F.col("t"))
            .drop("_f", "_l", "t0", "common_len"))
