"""Runs streaming queries over arriving files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from slicewise.session import work_dir
from slicewise.sinks.tables import landed
from slicewise.sources.tail import register_tail

Sink = Callable[[DataFrame, str], DataStreamWriter]


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Micro-batches whose progress a query keeps, so that counts over a run are whole.
PROGRESS = 1_000_000


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session of its own for streams. The number of state partitions is fixed for ever at the
    first run of a query: ``state_partitions``, by default the cluster's shuffle partitions, but no
    more than its cores, as each has a Python worker to start in every micro-batch. State lies
    in RocksDB, on disk and not in the heap."""
    s = spark.newSession()
    s.conf.set("spark.sql.session.timeZone", "UTC")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    s.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(PROGRESS))
    s.conf.set("spark.sql.shuffle.partitions",
               str(state_partitions or min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                           max(spark.sparkContext.defaultParallelism, 1))))
    return s


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark, over all micro-batches of a run."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress
               for op in p["stateOperators"])


def replay(spark: SparkSession, parts: Iterable[DataFrame], sink: Sink,
           fmt: str = "parquet", label: str = "stream",
           done: Callable[[StreamingQuery], None] | None = None) -> str:
    """Lets files arrive part by part and runs the query to the end of each part, always from
    the same checkpoint, as a scheduled job would. ``sink(stream, out)`` describes the query;
    ``done`` sees it after each part; the folder ``out`` is returned."""
    base = work_dir(spark, label)
    src, out, checkpoint = f"{base}/in", f"{base}/out", f"{base}/checkpoint"
    s = stream_session(spark)
    for part in parts:
        w = part.write.mode("append")
        if fmt == "csv":
            w = w.option("header", "true")
        w.format(fmt).save(src)
        reader = s.readStream.schema(part.schema)
        if fmt == "csv":
            reader = reader.option("header", "true")
        query = (sink(reader.format(fmt).load(src), out)
                 .option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        if done:
            done(query)
    return out


def follow(spark: SparkSession, cuts: Iterable[bytes], schema: StructType, sink: Sink, label: str = "tail",
           **options: str) -> str:
    """Appends byte strings to one live file and runs the query over it after each, always from the
    same checkpoint; the folder ``out`` is returned. The file is what a metric source writes."""
    base = work_dir(spark, label)
    out, checkpoint = f"{base}/out", f"{base}/checkpoint"
    s = stream_session(spark)
    register_tail(s)
    store, inner = pafs.FileSystem.from_uri(base) if "://" in base or base.startswith("file:") else (pafs.LocalFileSystem(), base)
    store.create_dir(inner)
    for more in cuts:
        live = f"{inner}/live.csv"
        there = store.get_file_info(live).type == pafs.FileType.File
        with (store.open_append_stream if there else store.open_output_stream)(live) as f:
            f.write(more)
        query = (sink(s.readStream.format("tail").schema(schema).options(**options).load(f"{base}/live.csv"), out)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    return out


def to_files(df: DataFrame, out: str, mode: str = "append") -> DataStreamWriter:
    return df.writeStream.outputMode(mode).format("parquet").option("path", out)


def to_batches(df: DataFrame, out: str, work: Callable[[DataFrame], DataFrame] | None = None,
               mode: str = "append") -> DataStreamWriter:
    """Each micro-batch is worked on as a batch DataFrame and written to a folder of its own
    number, so a repeated batch replaces itself. It is landed first: work that reads it twice would
    run the stream's operators twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{out}/batch={batch_id}"
        if not work:
            batch.write.mode("overwrite").parquet(target)
            return
        here = landed(batch, "batch")
        result = work(here)
        if here.isEmpty():
            result = here.sparkSession.createDataFrame([], result.schema)
        result.write.mode("overwrite").parquet(target)
    return df.writeStream.outputMode(mode).foreachBatch(write)
