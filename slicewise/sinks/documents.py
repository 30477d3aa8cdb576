"""Allocation documents and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise import dims


def allocation_document(units: DataFrame, keys: list[str]) -> DataFrame:
    """{cell: {slice: units}} as JSON per key, cells and slices in alphabetical order.

    A document holds one number per (cell, slice): its groups are bounded by the unit table."""
    def as_map(entries):
        return F.map_from_entries(F.array_sort(F.collect_list(entries)))
    per_cell = units.groupBy(*keys, "gnb").agg(as_map(F.struct("slice", "units")).alias("cell"))
    pairs = F.array_sort(F.collect_list(F.struct("gnb", F.to_json("cell").alias("text"))))
    body = F.transform(pairs, lambda p: F.concat(F.lit('"'), p["gnb"], F.lit('":'), p["text"]))
    return per_cell.groupBy(*keys).agg(
        F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}")).alias("document"))


def default_units(df: DataFrame, keys: list[str], demo: bool = False) -> DataFrame:
    """The document published before any period has passed: default units everywhere, or with
    ``demo`` a start that gives eMBB too little, so that the controller has something to mend."""
    spark = df.sparkSession
    d = (dims.inline_table(spark, ["gnb", "slice", "units_default"], dims.DEMO_UNITS) if demo
         else dims.unit_dim(spark).select("gnb", "slice", "units_default"))
    rows = df.select(*keys).distinct().withColumn("_g", F.explode(dims.unit_grid()))
    return (rows.select(*keys, "_g.*").join(d, ["gnb", "slice"])
            .select(*keys, "gnb", "slice", F.col("units_default").cast("bigint").alias("units")))


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result tables as CSV with header or as Parquet."""
    w = df.write.mode("overwrite")
    w.option("header", "true").csv(path) if fmt == "csv" else w.parquet(path)
