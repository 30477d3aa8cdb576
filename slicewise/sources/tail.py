"""Follows files that grow: a streaming source of the lines appended to CSV files.

An offset is the number of bytes taken from each file, and stands in the checkpoint. A batch ends at
the last line break there is, so a line that is still being written waits for its end; a batch
is read in byte ranges by many tasks. Restarted, the source goes on at the stored byte.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import DoubleType, IntegralType, StringType, StructType

# the source travels as it is, also to the worker beside the driver, which has no shipped packages
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that a task reads, and that are looked at for the last line break at a time.
RANGE, BLOCK = 16 << 20, 1 << 16


def _files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    """The store of ``path`` and its CSV files: itself, or those in a folder."""
    store, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = store.get_file_info(inner)
    if info.type == pafs.FileType.Directory:
        found = store.get_file_info(pafs.FileSelector(inner))
        return store, sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".csv"))
    return store, [inner] if info.type == pafs.FileType.File else []


def whole_lines(store: pafs.FileSystem, path: str, done: int) -> int:
    """Bytes of the file up to the end of its last whole line, at least ``done``."""
    with store.open_input_file(path) as f:
        end = f.size()
        while end > done:
            lo = max(done, end - BLOCK)
            cut = f.read_at(end - lo, lo).rfind(b"\n")
            if cut >= 0:
                return lo + cut + 1
            end = lo
    return done


class Piece(InputPartition):
    def __init__(self, path: str, lo: int, hi: int, end: int):
        self.path, self.lo, self.hi, self.end = path, lo, hi, end


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, header: bool, size: int):
        self.path, self.schema, self.header, self.size = path, schema, header, size
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, paths = _files(self.path)
        # a file is only looked at behind what is known of it
        self.seen.update({p: whole_lines(store, p, self.seen.get(p, 0)) for p in paths})
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.seen = {p: max(n, self.seen.get(p, 0)) for p, n in end.items()}
        return [Piece(p, lo, min(lo + self.size, n), n) for p, n in sorted(end.items())
                for lo in range(start.get(p, 0), n, self.size)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        """Rows of the lines that begin in the piece. A value that can't be read is null, as are
        missing ones at the end of a line; empty lines are left out."""
        store, _ = _files(self.path)
        make = [_converter(f.dataType) for f in self.schema.fields]
        csv.field_size_limit((1 << 31) - 1)
        for line in self._lines(store, partition):
            for cells in csv.reader([line]):
                yield tuple(f(cells[k]) if k < len(cells) else None for k, f in enumerate(make))

    def _lines(self, store: pafs.FileSystem, piece: Piece) -> Iterator[str]:
        with store.open_input_file(piece.path) as f:
            at, rest = piece.lo, b""
            skip = piece.lo > 0 and f.read_at(1, piece.lo - 1) != b"\n"      # begun in the piece before
            skip = skip or (self.header and piece.lo == 0)
            begun = piece.lo
            while at < piece.end and begun < piece.hi:
                block = f.read_at(min(BLOCK, piece.end - at), at)
                at += len(block)
                *whole, rest = (rest + block).split(b"\n")
                for line in whole:
                    if begun >= piece.hi:
                        return
                    begun += len(line) + 1
                    if not skip and line.strip():
                        yield line.rstrip(b"\r").decode("utf-8", "replace")
                    skip = False


def _converter(kind):
    if isinstance(kind, StringType):
        return lambda x: x if x != "" else None
    base = int if isinstance(kind, IntegralType) else float
    if not isinstance(kind, (IntegralType, DoubleType)):
        raise ValueError(f"columns of type {kind.simpleString()} are not read")

    def convert(x: str):
        try:
            return base(x)
        except ValueError:
            return None
    return convert


class TailSource(DataSource):
    """``spark.readStream.format("tail").schema(...).load(path)``: one file, or a folder of ``.csv`` files.
    Options: ``header`` (true: every file begins with names), ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["path"], schema, self.options.get("header", "true") == "true",
                          int(self.options.get("rangeBytes", RANGE)))


def register_tail(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
