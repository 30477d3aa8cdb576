"""Exact quantiles (linear interpolation) of groups of any size.

The built-in exact aggregate keeps every distinct value of a group in one task. Here a sketch
brackets each wanted rank, one pass counts the rows below each bracket, and only the rows
inside a bracket are ranked. Where a bracket turns out not to hold the wanted rank, the whole
value range of the group is ranked instead, so the result is exact in every case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewise.operators.joins import join_groups

SKETCH = 10000
MARGIN = 0.0005


def exact_quantiles(df: DataFrame, keys: list[str], value: Column,
                    probs: dict[str, float]) -> DataFrame:
    """One row per key with one column per entry of ``probs``."""
    vals = df.select(*keys, value.alias("_v")).filter("_v IS NOT NULL")
    names = list(probs)

    def sketch(shift: float) -> Column:
        ps = [F.lit(min(1.0, max(0.0, probs[n] + shift))) for n in names]
        return F.percentile_approx("_v", F.array(*ps), SKETCH)

    stats = vals.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        sketch(-MARGIN).alias("_lo"), sketch(MARGIN).alias("_hi"))

    # rows below and up to the end of each bracket, one pass with map-side combine
    counts = join_groups(vals, stats, keys).groupBy(*keys, "_n", "_min", "_max", "_lo", "_hi").agg(
        *[F.sum((F.col("_v") < F.col("_lo")[i]).cast("bigint")).alias(f"_b{i}")
          for i in range(len(names))],
        *[F.sum((F.col("_v") <= F.col("_hi")[i]).cast("bigint")).alias(f"_u{i}")
          for i in range(len(names))])

    def bracket(i: int, n: str) -> Column:
        rank = F.lit(float(probs[n])) * (F.col("_n") - 1)
        first = F.floor(rank).cast("bigint")
        second = F.least(first + 1, F.col("_n") - 1)
        held = (F.col(f"_b{i}") <= first) & (second < F.col(f"_u{i}"))
        return F.struct(
            F.lit(n).alias("q"), first.alias("first"), second.alias("second"),
            (rank - first).alias("part"),
            F.when(held, F.col("_lo")[i]).otherwise(F.col("_min")).alias("lo"),
            F.when(held, F.col("_hi")[i]).otherwise(F.col("_max")).alias("hi"),
            F.when(held, F.col(f"_b{i}")).otherwise(F.lit(0)).cast("bigint").alias("below"))

    brackets = counts.select(*keys, F.array(*[bracket(i, n) for i, n in enumerate(names)])
                             .alias("_b"))
    inside = (join_groups(vals, brackets, keys)
              .select(*keys, "_v", F.explode(F.filter(
                  "_b", lambda b: (b["lo"] <= F.col("_v")) & (F.col("_v") <= b["hi"])))
                  .alias("_b"))
              .groupBy(*keys, "_b", "_v").agg(F.count("_v").alias("_c")))
    w = (Window.partitionBy(*keys, "_b").orderBy("_v")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upto = inside.withColumn("_cum", F.sum("_c").over(w) + F.col("_b.below"))
    picked = upto.groupBy(*keys, "_b").agg(
        F.min(F.when(F.col("_cum") > F.col("_b.first"), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_cum") > F.col("_b.second"), F.col("_v"))).alias("_z"))
    value_at = F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_b.part")
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_b.q") == n, value_at)).alias(n) for n in names])
