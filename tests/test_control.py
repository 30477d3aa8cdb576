"""Loads, curves, costs and allocation."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.operators import allocate as A
from slicewise.operators import live as L
from slicewise.operators import load as LD


def test_default_units_meet_the_budget():
    for cell, budget in dims.BUDGETS:
        assert sum(r[2] for r in dims.UNITS if r[0] == cell) == budget


def loads(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["scenario", "gnb", "slice", "rho"]))


def all_loads(spark, values):
    return loads(spark, [(s, r[0], r[1], float(v)) for s, vs in values.items()
                         for r, v in zip(dims.UNITS, vs)])


def test_cost_falls_with_units(spark):
    rng = np.random.default_rng(0)
    c = A.cost_rows(all_loads(spark, {"a": rng.random(9) * 3})).toPandas().sort_values("n")
    for _, g in c.groupby(["gnb", "slice"]):
        assert (np.diff(g["cost"]) <= 1e-9).all()


def test_choices_meet_the_budget_and_never_lose(spark):
    rng = np.random.default_rng(1)
    df = all_loads(spark, {str(i): rng.random(9) * 3 for i in range(6)})
    p = A.problems(df, ["scenario"]).cache()
    three = A.allocation_report(A.choose_three(p), ["scenario"]).toPandas()
    fold = A.allocation_report(A.choose_fold(p), ["scenario"]).toPandas()
    key = ["scenario", "gnb"]
    three, fold = (x.sort_values(key).reset_index(drop=True) for x in (three, fold))
    pd.testing.assert_frame_equal(three, fold)
    budget = three["gnb"].map(dict(dims.BUDGETS))
    assert (three[[f"R_{s}_opt" for s in dims.SLICES]].sum(axis=1) == budget).all()
    assert (three["F_optimal"] <= three["F_default"] + 1e-9).all()


@pytest.mark.parametrize("n_slices,budget,exact", [(2, 7, True), (4, 9, True), (5, 8, True),
                                                   (4, 9, False)])
def test_fold_against_brute_force(spark, n_slices, budget, exact):
    rng = np.random.default_rng(n_slices)
    costs = np.round(rng.random((n_slices, budget)), 3)
    costs[0, 0] = np.nan                                        # below the floor
    rows = [(1, budget, [(i, [None if np.isnan(c) else float(c) for c in costs[i]])
                         for i in range(n_slices)])]
    df = spark.createDataFrame(rows, "id int, budget int, "
                                     "slices array<struct<slice_rank:int,costs:array<double>>>")
    best = A.choose_fold(df, exact).select("best.*").collect()[0]
    want = None
    for n in itertools.product(range(1, budget + 1), repeat=n_slices):
        if (sum(n) != budget if exact else sum(n) > budget):
            continue
        total = sum(costs[i, k - 1] for i, k in enumerate(n))
        if not np.isnan(total) and (want is None or (round(total, 9), n) < want):
            want = (round(total, 9), n)
    assert (best["total"], tuple(best["units"])) == (pytest.approx(want[0]), want[1])


def test_no_fitting_choice_keeps_default_or_floor(spark):
    df = spark.createDataFrame(
        [("a", "Macro", 3, [(1, "eMBB", [None, None, 0.1], 1, 3), (2, "URLLC", [None, 0.1, 0.1], 4, 2)])],
        "scenario string, gnb string, budget int, slices array<struct<slice_rank:int,slice:string,"
        "costs:array<double>,units_default:int,units_floor:int>>")
    out = A.live_allocation(A.choose_fold(df, exact=False), ["scenario"]).collect()
    assert {(r["slice"], r["units"]) for r in out} == {("eMBB", 3), ("URLLC", 4)}


def test_missing_slice_gets_the_flat_cost(spark):
    df = A.complete_grid(loads(spark, [("a", "Macro", "eMBB", 0.5)]), ["scenario"])
    c = A.cost_rows(df).filter("rho IS NULL")
    assert c.select("gnb", "slice").distinct().count() == 8
    assert c.agg(F.min("cost"), F.max("cost")).collect()[0] == (1.0, 1.0)


def test_calibration_finds_a_known_curve(spark):
    rho = np.linspace(0.1, 2.5, 40)
    pts = pd.DataFrame({"gnb": "Macro", "slice": "eMBB", "rho": rho,
                        "fraction_lost": 1 / (1 + np.exp(-4.335 * (rho - 1.2345)))})
    one = pd.DataFrame({"gnb": ["Macro"], "slice": ["mMTC"], "rho": [0.3], "fraction_lost": [0.0]})
    out = LD.calibrate(spark.createDataFrame(pd.concat([pts, one]))).toPandas().set_index("slice")
    assert out.loc["eMBB", "curve_k"] == pytest.approx(4.335, abs=0.006)
    assert out.loc["eMBB", "curve_rho"] == pytest.approx(1.2345, abs=0.0006)
    assert (out.loc["mMTC", "curve_k"], out.loc["mMTC", "curve_rho"]) == dims.DEFAULT_CURVE


def live(spark, lat, thr=5.0):
    return spark.createDataFrame(pd.DataFrame({
        "scenario": "a", "gnb": "Macro", "slice": "eMBB", "tick": np.arange(len(lat)),
        "lat": np.asarray(lat, float), "thr": thr}))


def test_predictive_ladder(spark):
    def one(lat, thr=5.0):
        return L.predictive_loads(live(spark, lat, thr), ["scenario"]).collect()[0]
    cap = 20 * 0.560
    short = one([10.0] * 59)
    assert (short["mode"], short["rho"]) == ("fallback_warmup", pytest.approx(5.0 / cap))
    calm = one([10.0] * 60)
    assert (calm["mode"], calm["rho"]) == ("forecast", pytest.approx(5.0 / cap))
    assert one([100.0] * 60)["rho"] == 2.0
    assert one([10.0] * 60, 50.0)["rho"] == 1.5
    # steep growth that the newest rows do not bear out is not trusted
    jump = one(list(np.exp(np.linspace(0, 8, 55))) + [10.0] * 5)
    assert jump["mode"] == "forecast_shift" and jump["p_viol"] == 0.0


def test_reactive_and_missing(spark):
    r = L.fill_missing(L.reactive_loads(live(spark, [10.0] * 8), ["scenario"]), ["scenario"])
    rho = {(x["gnb"], x["slice"]): x["rho"] for x in r.collect()}
    assert len(rho) == 9 and rho[("Macro", "URLLC")] == dims.NO_DATA_LOAD
    assert rho[("Macro", "eMBB")] == pytest.approx(5.0 / (20 * 0.560))
