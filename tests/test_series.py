"""Positions, running sums and frames must not depend on the chunk length."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slicewise.operators import kpi as K
from slicewise.operators import features as FE
from slicewise.operators.joins import join_small
from slicewise.operators.quantiles import exact_quantiles
from slicewise.operators.series import last_rows, over_frames, running_sums, with_positions

KEYS = ["run", "scenario", "slice", "gnb"]


@pytest.fixture(scope="module")
def rows():
    """One hot series with gaps and two short ones."""
    rng = np.random.default_rng(7)
    parts = []
    for name, n, top in (("hot", 400, 900), ("small", 20, 60), ("one", 1, 5)):
        ticks = np.sort(rng.choice(top, n, replace=False))
        parts.append(pd.DataFrame({
            "run": f"{name}-0", "scenario": name, "slice": "eMBB", "gnb": "Macro", "tick": ticks,
            "lat": np.round(rng.gamma(2.0, 20.0, n), 6), "thr": np.round(rng.random(n) * 30, 6),
            "loss": np.round(rng.random(n) * 100, 6), "load": 1.0, "jit": 2.0,
            "sla_ok": rng.random(n) > 0.1}))
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("chunk", [3, 16, 4096])
def test_positions_and_sums(spark, rows, chunk):
    df = spark.createDataFrame(rows)
    got = with_positions(df, KEYS, chunk=chunk).select("scenario", "tick", "pos", "series_len")
    got = got.toPandas().sort_values(["scenario", "tick"])
    want = rows.sort_values(["scenario", "tick"])
    g = want.groupby("scenario")
    assert got["pos"].tolist() == g.cumcount().tolist()
    assert got["series_len"].tolist() == g["tick"].transform("size").tolist()
    s = running_sums(df, KEYS, "tick", {"bad": F.col("sla_ok").cast("int")}, chunk=chunk)
    s = s.toPandas().sort_values(["scenario", "tick"])
    ok = want["sla_ok"].astype(int)
    assert s["bad"].tolist() == ok.groupby(want["scenario"]).cumsum().tolist()


@pytest.mark.parametrize("chunk", [5, 64, 4096])
def test_label_against_plain_loop(spark, rows, chunk):
    got = K.label_ahead(spark.createDataFrame(rows), chunk=chunk).toPandas()
    got = got.sort_values(["scenario", "tick"])["ok_ahead"].tolist()
    want = []
    for _, g in rows.sort_values(["scenario", "tick"]).groupby("scenario"):
        for t in g["tick"]:
            ahead = g[(g["tick"] > t) & (g["tick"] <= t + 15)]["sla_ok"]
            want.append(bool(ahead.all()))
    assert got == want


@pytest.mark.parametrize("chunk", [4, 50, 4096])
def test_features_against_pandas(spark, rows, chunk):
    s = with_positions(FE.base_features(spark.createDataFrame(rows)), KEYS, chunk=chunk)
    got = FE.training_features(s, KEYS, chunk=chunk).toPandas().sort_values(["scenario", "tick"])
    w = rows.sort_values(["scenario", "tick"]).reset_index(drop=True)
    lat = np.log1p(w["lat"])
    g = lat.groupby(w["scenario"])
    np.testing.assert_allclose(got["lat_log_trend"], g.diff().fillna(0), atol=1e-9)
    vol = g.transform(lambda x: x.rolling(5, min_periods=1).std()).fillna(0)
    np.testing.assert_allclose(got["lat_log_vol"], vol, atol=1e-9)


def test_frames_wider_than_a_chunk(spark, rows):
    df = with_positions(spark.createDataFrame(rows), KEYS)

    def cols(w):
        return {"s": F.sum("thr").over(w.rowsBetween(-9, 12))}
    a = over_frames(df, KEYS, "pos", cols, before=9, after=12, chunk=4).select("scenario", "pos", "s")
    b = over_frames(df, KEYS, "pos", cols, before=9, after=12).select("scenario", "pos", "s")
    a, b = (x.toPandas().sort_values(["scenario", "pos"]) for x in (a, b))
    np.testing.assert_allclose(a["s"], b["s"], rtol=1e-12)


def test_jitter_fallback(spark, rows):
    k = rows.drop(columns=["jit"]).assign(mean_jitter_ms=np.nan, packets_received=1)
    df = spark.createDataFrame(k).withColumn("mean_jitter_ms", F.nanvl("mean_jitter_ms", F.lit(None)))
    got = K.fill_jitter(df, chunk=8).toPandas().sort_values(["scenario", "tick"])["jit"]
    w = rows.sort_values(["scenario", "tick"])
    want = w.groupby("scenario")["lat"].transform(lambda x: x.rolling(5, min_periods=2).std())
    np.testing.assert_allclose(got, want.fillna(0), atol=1e-9)


def test_last_rows_prunes_before_the_shuffle(spark, rows):
    df = last_rows(spark.createDataFrame(rows), ["scenario"], 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    got = df.groupBy("scenario").count().toPandas().set_index("scenario")["count"].to_dict()
    assert got == {"hot": 5, "small": 5, "one": 1}


@pytest.mark.parametrize("values", [
    np.round(np.random.default_rng(1).gamma(0.3, 50, 3000), 4),       # long tail
    np.r_[np.zeros(2500), np.arange(500.0)],                          # mostly one value
    np.array([4.0]), np.array([1.0, 2.0])])
def test_exact_quantiles(spark, values):
    probs = {"a": 0.0, "q1": 0.25, "m": 0.5, "p95": 0.95, "z": 1.0}
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "v": values}))
    row = exact_quantiles(df, ["g"], F.col("v"), probs).collect()[0]
    for n, p in probs.items():
        assert row[n] == pytest.approx(np.quantile(values, p), abs=1e-9)
    row = exact_quantiles(df, [], F.col("v"), {"m": 0.5}).collect()[0]
    assert row["m"] == pytest.approx(np.median(values), abs=1e-9)


def test_exact_quantiles_with_a_useless_sketch(spark, monkeypatch):
    """A bracket that misses its rank must fall back to the whole range."""
    from slicewise.operators import quantiles as Q
    monkeypatch.setattr(Q, "MARGIN", -0.2)
    v = np.random.default_rng(3).random(500)
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "v": v}))
    row = Q.exact_quantiles(df, ["g"], F.col("v"), {"m": 0.5}).collect()[0]
    assert row["m"] == pytest.approx(np.median(v), abs=1e-12)


def test_join_small_both_ways(spark):
    left = spark.range(100).withColumnRenamed("id", "k")
    right = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for bound in (5, 100):
        assert join_small(left, right, ["k"], bound).agg(F.sum("v")).collect()[0][0] == 90
