"""The source that follows growing files."""

import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from slicewise.sources import tail as T
from slicewise.streaming import replay as RP

SHAPE = StructType().add("name", StringType()).add("at", DoubleType()).add("n", LongType())
ROWS = [(f"row é{i}", i / 4, i) for i in range(300)]
BODY = "name,at,n\n" + "".join(f"{a},{b},{c}\n" for a, b, c in ROWS)


def pieces(body, cuts):
    ends = [0, *cuts, len(body)]
    return [body[a:b] for a, b in zip(ends, ends[1:])]


@pytest.mark.parametrize("cuts", [[], [5, 11, 12, 1000, 1001, 2999]])
def test_any_cut_gives_every_row_once(spark, cuts):
    out = RP.follow(spark, pieces(BODY.encode(), cuts), SHAPE, RP.to_files)
    got = spark.read.parquet(out).collect()
    assert sorted(map(tuple, got)) == sorted(ROWS)


def test_torn_line_waits_and_odd_lines_do_no_harm(spark):
    body = b"name,at,n\na,1.5,2\r\n\n\"b,c\",x,3\nshort\nlast,2.5"
    out = RP.follow(spark, [body], SHAPE, RP.to_files)
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == sorted(
        [("a", 1.5, 2), ("b,c", None, 3), ("short", None, None)], key=str)


def plain(reader, end):
    return [r for p in reader.partitions({}, end) for r in reader.read(p)]


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_ranges_of_any_size_share_out_the_lines(tmp_path, size):
    (tmp_path / "x.csv").write_bytes(BODY.encode())
    (tmp_path / "y.csv").write_bytes(b"name,at,n\nz,1,1\nopen,2")
    (tmp_path / "other.txt").write_bytes(b"no\n")
    reader = T.TailReader(str(tmp_path), SHAPE, True, size)
    end = reader.latestOffset()
    assert end == {str(tmp_path / "x.csv"): len(BODY.encode()), str(tmp_path / "y.csv"): 16}
    assert plain(reader, end) == [*ROWS, ("z", 1.0, 1)]
    assert reader.partitions(end, end) == []


def test_a_restart_goes_on_at_the_byte(tmp_path):
    live = tmp_path / "x.csv"
    live.write_bytes(BODY.encode()[:999])
    first = T.TailReader(str(live), SHAPE, True, 64)
    a = first.latestOffset()
    live.write_bytes(BODY.encode())
    again = T.TailReader(str(live), SHAPE, True, 64)
    b = again.latestOffset()
    assert plain(first, a) + [r for p in again.partitions(a, b) for r in again.read(p)] == ROWS


def test_long_line_over_many_blocks(tmp_path):
    live = tmp_path / "x.csv"
    long = "w" * (3 * T.BLOCK)
    live.write_text(f"name,at,n\n{long},1,2\n{long}")
    reader = T.TailReader(str(live), SHAPE, True, 100)
    assert plain(reader, reader.latestOffset()) == [(long, 1.0, 2)]
    assert T.TailReader(str(tmp_path / "none.csv"), SHAPE, True, 100).latestOffset() == {}
