"""Positions, running sums and frames over long series.

A single series may hold a large part of all rows, so no window here is partitioned by the
series key alone. A series is cut into chunks of its integer axis; frames that cross a chunk
border see the neighbouring rows through a halo of copied rows, and running sums add the
offset of all earlier chunks. Results do not depend on the chunk length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 4096


def chunk_of(axis: str, chunk: int) -> Column:
    return F.floor(F.col(axis) / F.lit(chunk)).cast("bigint")


def running_sums(df: DataFrame, keys: list[str], axis: str, values: dict[str, Column],
                 tiebreak: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """Adds, per entry of ``values``, the inclusive running sum ``<name>`` and the series
    total ``<name>_total`` in the order (axis, *tiebreak)."""
    tmp = {name: f"_v_{name}" for name in values}
    part = df.withColumns({tmp[n]: c for n, c in values.items()} | {"_c": chunk_of(axis, chunk)})
    local = (Window.partitionBy(*keys, "_c").orderBy(axis, *tiebreak)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = part.withColumns({n: F.sum(tmp[n]).over(local) for n in values}).drop(*tmp.values())

    # one row per chunk: the table the offsets are computed on is `chunk` times smaller
    sums = part.groupBy(*keys, "_c").agg(*[F.sum(tmp[n]).alias(tmp[n]) for n in values])
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = sums.select(
        *keys, "_c",
        *[F.coalesce(F.sum(tmp[n]).over(before), F.lit(0)).alias(f"_o_{n}") for n in values],
        *[F.sum(tmp[n]).over(whole).alias(f"{n}_total") for n in values])
    out = rows.join(offsets, keys + ["_c"])
    return (out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in values})
            .drop("_c", *[f"_o_{n}" for n in values]))


def with_positions(df: DataFrame, keys: list[str], axis: str = "tick", pos: str = "pos",
                   length: str = "series_len", tiebreak: tuple[str, ...] = (),
                   chunk: int = CHUNK) -> DataFrame:
    """Adds the 0-based row position within the series and the length of the series."""
    one = running_sums(df, keys, axis, {"_n": F.lit(1).cast("bigint")}, tiebreak, chunk)
    return (one.withColumn(pos, F.col("_n") - 1)
            .withColumnRenamed("_n_total", length).drop("_n"))


def over_frames(df: DataFrame, keys: list[str], axis: str,
                columns: Callable[[WindowSpec], dict[str, Column]],
                before: int = 0, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Adds window columns whose frames reach at most ``before`` axis steps back and
    ``after`` steps ahead. ``columns`` receives the window (partition and order set).

    All columns of one call share one exchange and one sort.
    """
    lo = F.floor((F.col(axis) - after) / F.lit(chunk)).cast("bigint")
    hi = F.floor((F.col(axis) + before) / F.lit(chunk)).cast("bigint")
    spread = df.withColumn("_c", F.explode(F.sequence(lo, hi)))
    w = Window.partitionBy(*keys, "_c").orderBy(axis)
    return (spread.withColumns(columns(w))
            .filter(F.col("_c") == chunk_of(axis, chunk)).drop("_c"))


def last_rows(df: DataFrame, keys: list[str], n: int, axis: str = "tick",
              back: str = "rows_back") -> DataFrame:
    """Newest ``n`` rows per key with their distance from the end (1 = newest). The rank
    filter is applied by Spark before the shuffle too, so at most ``n`` rows per key and map
    task travel."""
    w = Window.partitionBy(*keys).orderBy(F.col(axis).desc())
    return df.withColumn(back, F.row_number().over(w)).filter(F.col(back) <= n)
