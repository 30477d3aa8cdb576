"""Cost tables and the budget-constrained choice of units.

The cost of every unit count of one slice is an array column; the choice is a fold over the
slices of one cell inside its row. No candidate pair ever becomes a row, so nothing is joined
or shuffled beyond one row per problem, and arrays are bounded by the unit budget of a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.functions import scalars as S


def with_facts(loads: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """Loads (gnb, slice, rho, ...) with units, limits, priority and loss curve."""
    spark = loads.sparkSession
    units = dims.unit_dim(spark)
    if curves is not None:
        units = units.drop("curve_k", "curve_rho").join(
            curves.select("gnb", "slice", "curve_k", "curve_rho"), ["gnb", "slice"])
    lim = dims.limit_dim(spark, "control").select(
        "slice", "thr_min", F.col("lat_max").alias("control_lat_max"))
    rank = dims.slice_dim(spark).select("slice", "slice_rank", "priority")
    return loads.join(units, ["gnb", "slice"]).join(lim, "slice").join(rank, "slice")


def cost_of(n: Column, live: bool = False) -> Column:
    args = [n, F.col("rho"), F.col("units_default"), F.col("unit_rate"), F.col("curve_k"),
            F.col("curve_rho"), F.col("thr_min")]
    return S.live_unit_cost(*args, F.col("priority")) if live else S.unit_cost(*args)


NO_DATA_COST = dims.WEIGHT_THROUGHPUT + dims.WEIGHT_LOSS


def cost_rows(loads: DataFrame, curves: DataFrame | None = None, live: bool = False) -> DataFrame:
    """One row per unit count 1..budget. A null load has cost 1 for every count."""
    rows = with_facts(loads, curves).withColumn("n", F.explode(F.sequence(F.lit(1), "budget")))
    return rows.withColumn("cost", F.coalesce(cost_of(F.col("n"), live), F.lit(NO_DATA_COST)))


def complete_grid(loads: DataFrame, keys: list[str]) -> DataFrame:
    """Every (key, cell, slice); combinations without data get a null load."""
    grid = (loads.select(*keys).distinct()
            .withColumn("_g", F.explode(dims.unit_grid())).select(*keys, "_g.*"))
    return grid.join(loads, [*keys, "gnb", "slice"], "left")


def problems(loads: DataFrame, keys: list[str], curves: DataFrame | None = None,
             live: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per (key, cell): its slices in order, each with its cost array (null below the
    floor in the live form)."""
    n_all = F.sequence(F.lit(1), F.col("budget"))
    one = lambda n: F.coalesce(cost_of(n, live), F.lit(NO_DATA_COST))       # noqa: E731
    if live:
        costs = F.transform(n_all, lambda n: F.when(n >= F.col("units_floor"), one(n)))
    else:
        costs = F.transform(n_all, one)
    rows = with_facts(loads, curves).withColumn("costs", costs)
    item = F.struct("slice_rank", "slice", "costs", "units_default", "units_floor", "rho",
                    "curve_k", "curve_rho", *extra)
    return rows.groupBy(*keys, "gnb").agg(
        F.sort_array(F.collect_list(item)).alias("slices"), F.max("budget").alias("budget"))


def choose_three(problem: DataFrame) -> DataFrame:
    """Exact minimum for three slices whose units add up to the budget: the third slice takes
    what the first two leave. Adds ``best`` (total, units)."""
    r = F.col("budget")

    def cost(i: int, n: Column) -> Column:
        return F.get(F.col("slices")[i]["costs"], n - 1)

    best = F.array_min(F.transform(
        F.sequence(F.lit(1), r - 2),
        lambda a: F.array_min(F.transform(
            F.sequence(F.lit(1), r - 1 - a),
            lambda b: F.struct(
                F.round(cost(0, a) + cost(1, b) + cost(2, r - a - b), 9).alias("total"),
                F.array(a, b, r - a - b).alias("units"))))))
    return problem.withColumn("best", best)


def choose_fold(problem: DataFrame, exact: bool = True) -> DataFrame:
    """Exact minimum for any number of slices. The running state holds, for every number of
    used units, the cheapest choice of the slices seen so far. ``exact`` asks for the whole
    budget, otherwise at most the budget may be used. ``best`` is null where no choice fits.
    """
    state = "array<struct<total:double,units:array<int>>>"
    r = F.col("budget")
    start = F.transform(
        F.sequence(F.lit(0), r),
        lambda u: F.when(u == 0, F.struct(F.lit(0.0).alias("total"),
                                          F.array().cast("array<int>").alias("units")))
    ).cast(state)

    def add(acc: Column, s: Column) -> Column:
        def step(u: Column) -> Column:
            def option(n: Column) -> Column:
                prev, c = F.get(acc, u - n), F.get(s["costs"], n - 1)
                return F.when(prev.isNotNull() & c.isNotNull(), F.struct(
                    F.round(prev["total"] + c, 9).alias("total"),
                    F.concat(prev["units"], F.array(n)).alias("units")))
            return F.when(u > 0, F.array_min(F.transform(F.sequence(F.lit(1), u), option)))
        return F.transform(F.sequence(F.lit(0), r), step).cast(state)

    table = F.aggregate("slices", start, add)
    best = F.element_at(table, -1) if exact else F.array_min(table)
    return problem.withColumn("best", best)


def default_objective(slices: Column) -> Column:
    return F.round(F.aggregate(slices, F.lit(0.0), lambda acc, s: acc + F.get(
        s["costs"], s["units_default"] - 1)), 9)


def allocation_report(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Objective under default and best units, gain, and both unit vectors. Where nothing fits
    the default units stand."""
    f_def = default_objective(F.col("slices"))
    f_opt = F.coalesce(F.col("best.total"), f_def)
    wide = {}
    for i, s in enumerate(dims.SLICES):
        default = F.col("slices")[i]["units_default"].cast("bigint")
        wide[f"R_{s}_opt"] = F.coalesce(F.get(F.col("best.units"), F.lit(i)).cast("bigint"),
                                        default)
        wide[f"R_{s}_def"] = default
    return (chosen.withColumns({"_d": f_def, "_o": f_opt})
            .select(*keys, "gnb", F.round("_d", 4).alias("F_default"),
                    F.round("_o", 4).alias("F_optimal"),
                    S.gain_pct(F.col("_d"), F.col("_o")).alias("gain_pct"),
                    *[c.alias(n) for n, c in wide.items()]))


def live_allocation(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """(key, gnb, slice, units) rows of the live choice; without a fitting choice the larger
    of default and floor."""
    fallback = F.transform("slices", lambda s: F.greatest(s["units_default"], s["units_floor"]))
    units = F.coalesce(F.col("best.units"), fallback)
    rows = chosen.select(*keys, "gnb", F.explode(F.arrays_zip(
        F.transform("slices", lambda s: s["slice"]).alias("slice"), units.alias("units")))
        .alias("z"))
    return rows.select(*keys, "gnb", F.col("z.slice").alias("slice"),
                       F.col("z.units").cast("bigint").alias("units"))


def against_default(report: DataFrame, keys: list[str]) -> DataFrame:
    """Best and default units as (key, cell, slice) rows."""
    return report.select(*keys, "gnb", F.explode(F.array(*[
        F.struct(F.lit(s).alias("slice"), F.col(f"R_{s}_opt").alias("units_opt"),
                 F.col(f"R_{s}_def").alias("units_def")) for s in dims.SLICES])).alias("a")
    ).select(*keys, "gnb", "a.*",
             (F.col("a.units_opt") - F.col("a.units_def")).alias("change"))
