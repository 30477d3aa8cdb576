"""Streams against their batch form, late rows, restarts, learning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slicewise.operators import federated as FD
from slicewise.operators import live as L
from slicewise.plans import live as PL
from slicewise.streaming import live as SL
from slicewise.streaming import replay as RP


def rows(spark, n=200, cells=("Macro", "Commerce", "Industrie"), seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(pd.concat([pd.DataFrame({
        "scenario": "a", "gnb": g, "slice": "eMBB", "simtime_s": np.arange(n, dtype=float),
        "avg_latency_ms": rng.gamma(2, 20, n), "throughput_mbps": rng.random(n) * 10,
        "pkt_count": 1, "pkt_loss_pct": 0.0}) for g in cells]))


def parts(df, *cuts):
    ends = [*cuts, 1e9]
    return [df.filter((F.col("simtime_s") >= a) & (F.col("simtime_s") < b))
            for a, b in zip([0, *cuts], ends)]


def test_history_equals_batch_after_restarts(spark):
    df = rows(spark)
    out = RP.replay(spark, parts(df, 3, 70, 150), lambda s, o: RP.to_files(
        SL.with_reactive_load(SL.history(s)), o))
    got = spark.read.parquet(out)
    assert got.count() == 12
    last = {r["gnb"]: r["rho"] for r in got.filter("last_tick = 199").collect()}
    b = L.reactive_loads(df.withColumnsRenamed({"avg_latency_ms": "lat", "throughput_mbps": "thr"}),
                         ["scenario"], "simtime_s")
    assert {r["gnb"]: pytest.approx(r["rho"]) for r in b.collect()} == last


def test_late_rows_are_dropped_and_counted(spark):
    df = rows(spark, 120)
    late = df.filter("simtime_s < 10")
    dropped = []

    out = RP.replay(spark, [df, late], lambda s, o: RP.to_files(SL.tumbling_kpi(s), o),
                    done=lambda q: dropped.append(RP.dropped_rows(q)))
    # rows are combined per period and key before they reach the state
    assert dropped[0] == 0 and dropped[1] == 3
    t = spark.read.parquet(out)
    assert t.groupBy("period_start").agg(F.max("n_rows"), F.count("*")).orderBy(
        "period_start").collect() == [(p, 15, 3) for p in (0, 15, 30, 45, 60)]


def plain_learning(lat, thr, rate):
    """The same update over whole periods in plain arrays."""
    n = len(lat) // SL.PERIOD
    log = np.log1p(lat)[: n * SL.PERIOD].reshape(n, -1).mean(axis=1)
    t = thr[: n * SL.PERIOD].reshape(n, -1).mean(axis=1) / 10
    xs, ys, w, out = [], [], np.zeros(3), []
    for p in range((len(lat) - 1 - 30) // SL.PERIOD):
        if p > 0:
            xs.append([1.0, log[p - 1], t[p - 1]])
            ys.append(log[p])
            if len(ys) >= SL.BATCH:
                w, loss = SL.gradient_step(w, np.array(xs[-8:]), np.array(ys[-8:]), rate)
                out.append((p, loss, *w))
    return np.array(out)


def test_online_learning(spark):
    df = rows(spark, 600, ("Macro",))
    out = RP.replay(spark, parts(df, 100, 333), lambda s, o: RP.to_files(
        SL.online_learning(s, rate=0.05), o))
    got = spark.read.parquet(out).filter("ready").orderBy("period").toPandas()
    src = df.orderBy("simtime_s").toPandas()
    want = plain_learning(src["avg_latency_ms"].to_numpy(), src["throughput_mbps"].to_numpy(), 0.05)
    np.testing.assert_allclose(got["loss"], want[:, 1], rtol=1e-9)
    np.testing.assert_allclose(np.vstack(got["w"]), want[:, 2:], rtol=1e-9)
    assert want[-1, 1] < want[0, 1]
    assert spark.read.parquet(out).agg(F.max("n_buffer")).collect()[0][0] <= SL.BUFFER


def test_gradient_is_clipped():
    w, _ = SL.gradient_step(np.zeros(3), np.full((8, 3), 100.0), np.full(8, 100.0), 1.0)
    assert np.linalg.norm(w) == pytest.approx(1.0)


def test_federated_rounds(spark):
    u = spark.createDataFrame(
        [("a", g, "eMBB", s, [float(s), float(i)]) for s in range(0, 11)
         for i, g in enumerate(("Macro", "Commerce"))] + [("a", "Macro", "mMTC", 5, [1.0, 1.0])],
        "scenario string, gnb string, slice string, step bigint, w array<double>")
    got = {(r["step"], r["idx"]): (r["value"], r["n_cells"]) for r in SL.federated_rounds(u).collect()}
    assert got == {(5, 0): (5.0, 2), (5, 1): (0.5, 2), (10, 0): (10.0, 2), (10, 1): (0.5, 2)}


def test_fits_against_numpy(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"slice": "eMBB", "gnb": rng.choice(["Macro", "Commerce"], 500),
                        "a": rng.normal(size=500), "b": rng.normal(size=500)})
    pdf["y"] = 2 * pdf["a"] - pdf["b"] + 3 + (pdf["gnb"] == "Macro") + rng.normal(size=500) * 0.1
    sums = FD.normal_sums(spark.createDataFrame(pdf).repartition(4), ["a", "b"], "y").cache()
    fit = FD.federated_fit(sums, 2).toPandas()
    locals_ = {}
    for g, p in pdf.groupby("gnb"):
        x = np.column_stack([p[["a", "b"]], np.ones(len(p))])
        locals_[g] = np.linalg.lstsq(x, p["y"], rcond=None)[0]
    avg = np.mean(list(locals_.values()), axis=0)
    for g, p in pdf.groupby("gnb"):
        mine = fit[fit["gnb"] == g].sort_values("idx")
        np.testing.assert_allclose(mine["local"], locals_[g], rtol=1e-8)
        np.testing.assert_allclose(mine["average"], avg, rtol=1e-8)
        x = np.column_stack([p[["a", "b"]], np.ones(len(p))])
        want = np.linalg.solve(x.T @ x / len(p) + 0.01 * np.eye(3),
                               x.T @ p["y"] / len(p) + 0.01 * avg)
        np.testing.assert_allclose(mine["proximal"], want, rtol=1e-8)


def test_weighted_sample_follows_the_weights(spark):
    w = spark.range(4000).select(F.lit("eMBB").alias("slice"), F.col("id").alias("start"),
                                 F.when(F.col("id") < 400, 10.0).when(F.col("id") == 3999, 0.0).otherwise(1.0).alias("weight"))
    s = FD.weighted_sample(w).cache()
    assert s.count() == 4000 and s.select("draw").distinct().count() == 4000
    assert s.filter("start < 400").count() / 4000 == pytest.approx(4000 / 7599, abs=0.03)
    assert s.filter("start = 3999").count() == 0
    again = FD.weighted_sample(w.repartition(7))
    assert s.select("draw", "start").exceptAll(again.select("draw", "start")).count() == 0
    one = w.withColumn("weight", F.when(F.col("start") == 5, 1e9).otherwise(1e-9))       # all draws in one stretch
    assert FD.weighted_sample(one).groupBy("start").count().collect() == [(5, 4000)]
    assert FD.weighted_sample(w.limit(0)).collect() == []


def test_split_is_exact_and_ranks_few_rows(spark):
    w = spark.range(5000).select(F.when(F.col("id") < 4990, "eMBB").otherwise("mMTC").alias("slice"), F.col("id").alias("start"))
    rep = FD.split_parts(w, ["slice", "start"]).cache()
    count = lambda s, p: rep.filter(f"slice = '{s}' AND part = '{p}'").count()
    assert [count("eMBB", "val"), count("eMBB", "train"), count("mMTC", "val"), count("mMTC", "train")] == [748, 4242, 1, 9]
    for other in (FD.split_parts(w.repartition(7), ["slice", "start"]), FD.split_parts(w, ["slice", "start"], narrow=50, bits=4)):
        assert rep.exceptAll(other).count() == 0 and other.count() == 5000
    none = FD.split_parts(w, ["slice", "start"], val_share=0.0, narrow=50)
    assert none.filter("part = 'val'").count() == 0 and none.count() == 5000
    whole = FD.split_parts(w, ["slice", "start"], val_share=1.0, narrow=50)
    assert whole.filter("part = 'val'").count() == 5000


def test_huber_ignores_outliers(spark):
    from slicewise.operators import robust as R
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"slice": "eMBB", "a": rng.normal(size=400), "b": rng.normal(size=400)})
    pdf["y"] = 1 + 2 * pdf["a"] - pdf["b"] + rng.normal(size=400) * 0.05
    dirty = pdf.copy()
    dirty.loc[::20, "y"] += 500.0
    fits = R.huber_fit(spark.createDataFrame(dirty), ["a", "b"], ["y"], ["slice"])
    out = R.predict(spark.createDataFrame(pdf), fits, ["a", "b"], ["y"], ["slice"])
    assert out.select(F.avg(F.abs(F.col("p_y") - F.col("y")))).collect()[0][0] < 0.2


def live_rows(spark, n=130, series=(("Macro", "eMBB"), ("Macro", "URLLC"), ("Commerce", "mMTC"))):
    rows = [("S", g, s, float(t), 5.0 + (t * (k + 2)) % 40, 1.0 + t % 3, 1)
            for k, (g, s) in enumerate(series) for t in range(n) if not (s == "URLLC" and t > 70)]
    return spark.createDataFrame(rows, "scenario string, gnb string, slice string, simtime_s double, "
                                 "avg_latency_ms double, throughput_mbps double, pkt_count bigint")


def slabs(rows, seconds, by=None):
    """Sets of files: slabs of event time, or one set per value of ``by`` within each slab."""
    last = int(rows.agg(F.max("simtime_s")).first()[0])
    out = [rows.filter((F.col("simtime_s") >= a) & (F.col("simtime_s") < a + seconds)) for a in range(0, last + 1, seconds)]
    if by:
        values = sorted(r[0] for r in rows.select(by).distinct().collect())
        out = [part.filter(F.col(by) == v) for part in out for v in values]
    return out


def shuffled(rows, grace, size, seed=1):
    """Rows in an order in which none comes more than ``grace`` seconds after a later one."""
    pdf = rows.toPandas()
    order = np.argsort(pdf["simtime_s"] + np.random.default_rng(seed).random(len(pdf)) * grace)
    pdf = pdf.iloc[order]
    return [rows.sparkSession.createDataFrame(pdf.iloc[i:i + size], rows.schema) for i in range(0, len(pdf), size)]


def run(spark, arrivals, build):
    lost = []
    out = RP.replay(spark, arrivals, build, done=lambda q: lost.append(RP.dropped_rows(q)))
    return spark.read.parquet(out), sum(lost)


def test_documents_do_not_depend_on_arrival(spark):
    """One document per cell and 15 s, whether rows come by time, by cell or shuffled within the grace."""
    rows, got = live_rows(spark), []
    for arrivals in ([rows], slabs(rows, 28, "gnb"), shuffled(rows, 29, 130)):
        fits, lost = run(spark, arrivals, lambda s, o: RP.to_files(SL.periodic_fits(s), o))
        assert lost == 0
        got.append(sorted((r.gnb, r.period_end, r.document) for r in SL.allocate_predictive(fits).collect()))
    # the watermark ends at 129 - 30
    assert [r[:2] for r in got[0]] == [(g, e) for g in ("Commerce", "Macro") for e in range(15, 100, 15)]
    assert got[0] == got[1] == got[2]


def test_reactive_documents_and_rows_past_the_grace(spark):
    rows = live_rows(spark)
    late = rows.filter("simtime_s < 40").withColumn("avg_latency_ms", F.lit(5000.0))
    build = lambda s, o: RP.to_batches(SL.periodic_fits(s), o, SL.allocate_reactive)
    key = lambda r: (r.gnb, r.period_end, r.document)
    plain, _ = run(spark, [rows], build)
    mixed, lost = run(spark, [rows.filter("simtime_s < 90"), late, rows.filter("simtime_s >= 90")], build)
    assert sorted(map(key, plain.collect())) == sorted(map(key, mixed.collect()))
    assert lost == late.count()


def test_a_gap_is_published_and_a_long_one_starts_afresh(spark):
    one = live_rows(spark, 40, (("Macro", "eMBB"),))
    moved = lambda s: one.withColumn("simtime_s", F.col("simtime_s") + s)
    pause, far = 105, 105 + 40 + SL.IDLE + 600
    for arrivals in ([one.union(moved(pause)).union(moved(far))], [one, moved(pause), moved(far)]):
        out, _ = run(spark, arrivals, lambda s, o: RP.to_files(SL.periodic_fits(s), o))
        got = {r.period_end: r.n_rows for r in out.collect()}
        want = {e: len([t for t in [*range(40), *range(pause, pause + 40)] if t < e][-60:]) for e in range(15, 151, 15)}
        start = far // 15 * 15
        want |= {e: e - far for e in range(start + 15, far + 39 - 30 + 1, 15)}
        assert got == want


def test_learning_does_not_depend_on_arrival(spark):
    rows = live_rows(spark, 220, (("Macro", "eMBB"), ("Commerce", "eMBB"), ("Macro", "mMTC")))
    for build in (lambda s, o: RP.to_files(SL.online_learning(s, 0.01), o), lambda s, o: RP.to_files(SL.federated_learning(s, 0.01), o)):
        got = []
        for arrivals in ([rows], shuffled(rows, 29, 200)):
            out, lost = run(spark, arrivals, build)
            assert lost == 0
            got.append({(r.gnb, r.slice, r.period, r.step): [*r.w, np.nan if r.loss is None else r.loss] for r in out.collect()})
        assert max(k[2] for k in got[0]) == (219 - 30) // 15 - 1
        for other in got[1:]:
            assert other.keys() == got[0].keys()
            assert all(np.allclose(other[k], v, rtol=1e-9, equal_nan=True) for k, v in got[0].items())


def test_random_batch_is_drawn_from_the_whole_buffer():
    at = np.arange(100, 164)
    sets = [SL.drawn("a|Macro|eMBB", p, at) for p in range(400)]
    assert all(len(set(s)) == SL.BATCH for s in sets)
    counts = np.bincount(np.concatenate(sets), minlength=64)
    assert counts.min() > 25 and counts.max() < 80               # 50 each on average
    assert (SL.drawn("a|Macro|eMBB", 7, at) == sets[7]).all()
    few = SL.drawn("x", 1, np.arange(SL.BATCH))
    assert few.tolist() == list(range(SL.BATCH))


def test_learners_keep_their_state(spark):
    a = SL._Learner()
    for p in range(80):
        a.learn(p, (2.0, p * 0.1, 3.0 + p), 0.01, "s")
        b = SL._Learner.of(a.state())
        assert b.steps == a.steps and (b.w == a.w).all() and (b.x == a.x).all() and (b.at == a.at).all()
    assert len(a.y) == SL.BUFFER and a.at[-1] == 79


def test_demo_start_meets_the_budget(spark):
    from slicewise import dims
    from slicewise.sinks.documents import default_units
    keys = spark.createDataFrame([("a",)], "scenario string")
    got = {(r.gnb, r.slice): r.units for r in default_units(keys, ["scenario"], demo=True).collect()}
    for cell, budget in dims.BUDGETS:
        assert sum(u for (g, _), u in got.items() if g == cell) == budget
    usual = {(r.gnb, r.slice): r.units for r in default_units(keys, ["scenario"]).collect()}
    assert all(got[c, "eMBB"] < usual[c, "eMBB"] for c in dims.CELLS)


def test_late_rows_change_no_published_step(spark):
    rows = live_rows(spark, 400, (("Macro", "eMBB"),))
    late = rows.filter("simtime_s < 5").withColumn("avg_latency_ms", F.lit(9000.0))
    plain, mixed = (spark.read.parquet(RP.replay(spark, parts, lambda s, o: RP.to_files(SL.online_learning(s), o))).collect()
                    for parts in ([rows], [rows.filter("simtime_s < 200"), late, rows.filter("simtime_s >= 200")]))
    key = lambda r: (r.period, r.step, r.n_buffer, r.w)
    assert sorted(map(key, plain)) == sorted(map(key, mixed))
    assert len({r.period for r in mixed}) == len(mixed)


def test_state_of_an_ended_series_goes(spark):
    rows = live_rows(spark, 60, (("Macro", "eMBB"),))
    later = live_rows(spark, 20, (("Macro", "URLLC"),)).withColumn("simtime_s", F.col("simtime_s") + 2 * SL.IDLE)
    last = later.withColumn("simtime_s", F.col("simtime_s") + 60)
    left = []
    RP.replay(spark, [rows, later, last], lambda s, o: RP.to_files(SL.history(s), o),
              done=lambda q: left.append(q.lastProgress["stateOperators"][0]["numRowsTotal"]))
    assert left[0] == 1 and left[-1] == 1
