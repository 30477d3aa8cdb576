"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side with at most this many rows of a few numbers each (16 MB or so) may be broadcast.
BROADCAST_ROWS = 500_000


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def small(df: DataFrame, n_rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within ``bound``; otherwise left to
    a shuffled join. ``df`` must hold a few numbers or one short string a row."""
    return F.broadcast(df) if n_rows <= bound else df


def row_key(*cols: Column) -> Column:
    """128 bits that name a row by its content. Rows with equal keys are equal in ``cols``, so
    an operator whose decision depends on ``cols`` alone may join its decision back by them.
    Nulls differ from every value."""
    parts = [F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-")) for c in cols]
    return F.md5(F.concat_ws("\u0000", *parts))
