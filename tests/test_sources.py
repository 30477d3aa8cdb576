"""Hand-written logs and files."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from slicewise.operators import kpi as K
from slicewise.operators import scenario as SC
from slicewise.sinks.documents import write_result
from slicewise.sources import kpi_files as KF
from slicewise.sources import signal_log as SL

A_VEC = """version 3
vector 1 Net.serverEmbb.app[0] cbrFrameDelay:vector ETV
vector 2 Net.serverEmbb.app[7] cbrRcvdPkt:vector ETV
vector 3 Net.ueUrllc_B[2].app[0] cbrSentPkt:vector ETV
vector 4 Net.ueUrllc_B[2].app[0] cbrJitter:vector ETV
vector 5 Net.serverMmtc.app[2] cbrFrameLoss:vector ETV
vector 6 Net.router
vector 7 Net.gnbCommerce.phy other:vector ETV
attr unit s
1\t10\t0.25\t0.020
1\t11\t0.75\t0.040
2\t12\t0.80\t1
3\t13\t1.10\t1
4\t14\t1.20\t0.5
5\t15\t3.50\t0.1
1\t16\t0.9
1\t17\tabc\t0.5
1\t18\t1.0\tn/a
"""
B_VEC = """vector 1 Net.ueMmtc_C[0].app[0] cbrSentPkt:vector ETV
1\t10\t0.5\t1
1\t11\t0.6\t1
"""
A_SCA = """scalar Net.serverEmbb.app[0] packetReceived:count 7
scalar Net.serverEmbb.app[0] packetReceived:sum(packetBytes) 700
scalar Net.ueUrllc_B[2].app[0] cbrSentPkt:count 5
scalar Net.ueUrllc_B[2].app[0] cbrSentPkt:count nan
scalar Net.serverEmbb.app[0] cbrFrameLoss:sum -inf
scalar Net.other.x cbrSentPkt:count 9
scalar short
"""


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    (d / "Quiet-day-0.vec").write_text(A_VEC)
    (d / "Storm-1.vec").write_text(B_VEC)
    (d / "Quiet-day-0.sca").write_text(A_SCA)
    return str(d)


def test_scan(spark, logs):
    decl, samples = SL.scan_signal_log(spark, logs)
    assert decl.filter("run = 'Quiet-day-0'").count() == 6          # the three-word line is out
    assert samples.groupBy("run").count().orderBy("run").collect() == [
        ("Quiet-day-0", 6), ("Storm-1", 2)]
    v = {r["vec_id"]: r for r in SL.relevant_vectors(decl).filter("run = 'Quiet-day-0'").collect()}
    assert set(v) == {"1", "2", "3", "5"}           # no client jitter, no slice on 7
    assert (v["1"]["slice"], v["1"]["gnb"], v["1"]["scenario"]) == ("eMBB", "Macro", "Quiet-day")
    assert v["2"]["gnb"] == "Macro"                 # unknown application number
    assert (v["3"]["slice"], v["3"]["gnb"]) == ("URLLC", "Commerce")
    assert v["5"]["gnb"] == "Industrie"


def test_landed_scan_is_the_same(spark, logs):
    for a, b in zip(SL.scan_signal_log(spark, logs), SL.land_signal_log(spark, logs)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_buckets(spark, logs):
    decl, samples = SL.scan_signal_log(spark, logs)
    b = K.kpi_buckets(SL.attach_keys(samples, SL.relevant_vectors(decl)))
    got = {(r["run"], r["slice"], r["gnb"], r["tick"]): r for r in b.collect()}
    assert len(got) == 4
    first = got[("Quiet-day-0", "eMBB", "Macro", 0)]
    assert first["mean_delay_ms"] == pytest.approx(30.0) and first["packets_received"] == 1
    # the ignored loss signal still makes a bucket, and ids of another run do not mix in
    assert got[("Quiet-day-0", "mMTC", "Industrie", 3)]["packets_sent"] == 0
    assert got[("Storm-1", "mMTC", "Industrie", 0)]["packets_sent"] == 2
    k = {r["slice"]: r for r in K.kpi_formulas(b).filter("run = 'Quiet-day-0'").collect()}
    assert k["URLLC"]["loss"] == 100.0 and k["URLLC"]["lat_source"] == "estimated"
    assert k["URLLC"]["lat"] == pytest.approx(51.0)     # no throughput: base 1 plus 50
    assert K.run_duration(samples).filter("run = 'Storm-1'").collect()[0]["max_time"] == 0.6


def test_catalog_and_scalars(spark, logs):
    c = {r["run"]: r for r in SL.run_catalog(spark, logs).collect()}
    assert c["Quiet-day-0"]["has_scalars"] and not c["Storm-1"]["has_scalars"]
    assert c["Quiet-day-0"]["scenario"] == "Quiet-day"
    assert [r["run"] for r in SL.run_catalog(spark, logs, "Sto").collect()] == ["Storm-1"]
    s = SL.scan_scalar_log(spark, logs)
    assert s.count() == 6 and s.filter("value IS NULL").count() == 2
    t = {(r["slice"], r["gnb"]): r for r in SL.scalar_totals(s).collect()}
    assert t[("eMBB", "Macro")]["received"] == 7 and t[("eMBB", "Macro")]["bytes"] == 700
    assert t[("URLLC", "Commerce")]["sent"] == 5


def test_number_flags_and_bad_times(spark, tmp_path):
    cols = [c[0] for c in KF.KPI_COLUMNS]
    row = ["2024-01-01T00:00:05Z", "eMBB", "Macro", "s", 1, 2, 3, 4, 5, 10, 50, 1]
    pd.DataFrame([row + [1, 0, 1], ["bad"] + row[1:] + ["true", "false", 1]],
                 columns=cols).to_csv(tmp_path / "k.csv", index=False)
    r = KF.read_kpi_csv(spark, str(tmp_path)).orderBy("tick").collect()
    assert [x["tick"] for x in r] == [None, 5]
    assert all(x["sla_ok"] is True and x["ok_ahead"] is False for x in r)


def test_missing_mode_is_tolerated(spark, tmp_path):
    rows = spark.createDataFrame([("baseline", "s", 1.0, "Macro", "eMBB", 2.0, 3.0, 4, 5.0)],
                                 "mode string, " + KF.LIVE_SCHEMA)
    KF.write_modes(rows, str(tmp_path / "m"))
    assert [r["mode"] for r in KF.read_modes(spark, str(tmp_path / "m")).collect()] == ["baseline"]


def test_write_result(spark, tmp_path):
    df = spark.range(3)
    for fmt in ("csv", "parquet"):
        write_result(df, str(tmp_path / fmt), fmt)
        back = spark.read.format(fmt).option("header", "true").load(str(tmp_path / fmt))
        assert back.count() == 3


def test_noise_follows_the_value(spark):
    z = spark.range(4000).select(
        F.lit("n").alias("name"), F.lit("eMBB").alias("slice"), F.lit("Macro").alias("gnb"),
        F.col("id").alias("pos"), F.lit(4000).alias("common_len"),
        *[F.lit(50.0).alias(f"{side}_{c}") for side in ("low", "high") for c in SC.BLENDED])
    out = SC.blend(z, F.lit(0.5), noise=0.02, chunk=256).toPandas()
    assert out["lat"].std() == pytest.approx(1.0, rel=0.1)
    assert out["loss"].between(0, 100).all() and out["lat"].mean() == pytest.approx(50, abs=0.1)


def test_throughput_falls_back_to_the_reported_rate(spark):
    s = spark.createDataFrame(
        [("r", "r", "eMBB", "Macro", 0.1, sig, v) for sig, v in
         (("cbrReceivedThroughput", 4e6), ("cbrGeneratedThroughput", 8e6))]
        + [("r", "r", "eMBB", "Macro", 2.1, "cbrReceivedBytes", 250000.0)],
        "run string, scenario string, slice string, gnb string, t double, signal string, v double")
    k = {r["tick"]: r["thr"] for r in K.kpi_formulas(K.kpi_buckets(s)).collect()}
    assert k == {0: 6.0, 2: 2.0}
    # a bucket twice as wide halves the rate of the same bytes
    k = {r["tick"]: r["thr"] for r in K.kpi_formulas(K.kpi_buckets(s, 2.0), 2.0).collect()}
    assert k == {0: 6.0, 1: 1.0}
