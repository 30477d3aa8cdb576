"""Packaging, work folders and file names."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from slicewise.functions import naming
from slicewise.operators import kpi as K
from slicewise.operators import series as SE
from slicewise.sources import signal_log as SL

ROOT = Path(__file__).resolve().parents[1]


def test_workers_find_the_package_from_another_folder(tmp_path):
    """A stream whose state function lives in the package, started elsewhere; nothing stays."""
    (tmp_path / "shared").mkdir()
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from slicewise.session import build_session, work_dir
from slicewise.streaming import live, replay
s = build_session("local[2]", 2, spark__checkpoint__dir={str(tmp_path / "shared")!r}, spark__driver__memory="1g")
rows = s.createDataFrame([("S", "Macro", "eMBB", float(t), 5.0, 1.0, 1) for t in range(200)],
    "scenario string, gnb string, slice string, simtime_s double, avg_latency_ms double, throughput_mbps double, pkt_count bigint")
out = replay.replay(s, [rows], lambda x, o: replay.to_files(live.online_learning(x), o))
print("PERIODS", s.read.parquet(out).count())
from pyspark.sql.types import LongType, StructType
out = replay.follow(s, [b"n\\n1\\n2", b"3\\n4\\n"], StructType().add("n", LongType()), replay.to_files)
print("ROWS", sorted(r.n for r in s.read.parquet(out).collect()))
s.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240,
                          env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "PERIODS 11" in done.stdout, done.stderr[-2000:]            # those that end by 199 - 30
    assert "ROWS [1, 4, 23]" in done.stdout, done.stderr[-2000:]
    assert list((tmp_path / "shared").glob("slicewise*")) == []


def test_run_names_keep_what_belongs_to_them(spark, tmp_path):
    names = ["A-x=1-0", "B-x=1-0", "My Run-0", "50%+1-0"]
    for i, n in enumerate(names):
        (tmp_path / f"{n}.vec").write_text(f"vector 1 serverEmbb.app[{i % 3}] cbrFrameDelay:vector ETV\n1\t0\t0.5\t{i}\n")
    decl, samples = SL.scan_signal_log(spark, str(tmp_path))
    assert sorted(r.run for r in decl.collect()) == sorted(names)
    keyed = SL.attach_keys(samples, SL.relevant_vectors(decl))
    assert {(r.run, r.v) for r in keyed.collect()} == {(n, float(i)) for i, n in enumerate(names)}
    assert {r.run for r in SL.run_catalog(spark, str(tmp_path)).collect()} == set(names)
    d2, s2 = SL.land_signal_log(spark, str(tmp_path), only_relevant=True)
    assert s2.count() == 4 and d2.count() == 4
    folder = spark.range(1).select(naming.run_of(F.lit("/x/log=A-x%3D1-0.vec/part-0"), "vec").alias("r"))
    assert folder.first().r == "A-x=1-0"


def test_frames_reach_below_zero(spark):
    rows = [("S", t, float(t % 7 == 0)) for t in range(-20, 20)]
    df = spark.createDataFrame(rows, "k string, tick long, v double")
    for chunk in (3, 4096):
        got = SE.over_frames(df, ["k"], "tick", lambda w: {"m": F.max("v").over(w.rowsBetween(-2, 3))}, 2, 3, chunk)
        want = {t: max(v for _, s, v in rows if t - 2 <= s <= t + 3) for _, t, _ in rows}
        assert {r.tick: r.m for r in got.collect()} == want
    assert K is not None
