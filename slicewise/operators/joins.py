"""Joins of many rows with a side that is usually small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.sinks.tables import landed


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Attach one row per group to the rows; without keys there is exactly one group.

    The planner takes an aggregate to be as large as its input and would shuffle the rows by
    the few, possibly hot, group keys. Landed first, the groups have a known size: below the
    broadcast threshold the rows stay where they are, above it the join shuffles as usual.
    """
    if keys:
        return rows.join(landed(groups, "groups"), keys)
    one = F.lit(1).alias("_one")
    small = landed(groups.select("*", one), "groups")
    return rows.select("*", one).join(small, "_one").drop("_one")


def join_small(rows: DataFrame, other: DataFrame, on: list[str],
               max_bytes: int = 64 << 20) -> DataFrame:
    """Join with a side that may exceed the broadcast threshold and still be worth sending.

    The side is landed, so its rows are counted where they lie and its row width is known from
    its values: the bytes decide, and beyond them it is an ordinary join, whose skew Spark splits
    at run time."""
    other = landed(other, "side")
    width = sum((F.coalesce(F.length(F.col(c)), F.lit(0)) + 16) if t == "string" else F.lit(16)
                for c, t in other.dtypes)
    size = other.agg(F.sum(width)).first()[0] or 0
    return rows.join(F.broadcast(other) if size <= max_bytes else other, on)
