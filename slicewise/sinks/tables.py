"""Intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

from slicewise.session import work_dir


def landed(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once and read it back. Cuts lineage in a way that survives lost
    executors, keeps a scan from being repeated by plans that use its result twice, and gives
    the planner the true size of the data."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it the shuffle files of a query are removed when the query ends, instead of when the
    driver happens to collect its garbage. For jobs of several steps that land their results."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def batches_within(spark: SparkSession, n_bytes: int) -> AbstractContextManager[None]:
    """Within it the batches that go to Python workers are closed at ``n_bytes``, however many rows
    that is. For steps that land their results and hold several copies of a batch of long texts."""
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))
