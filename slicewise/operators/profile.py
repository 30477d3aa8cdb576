"""Data-quality and exploratory aggregates of the KPI table."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise import dims
from slicewise.functions import naming, scalars as S
from slicewise.operators.joins import join_groups
from slicewise.operators.quantiles import exact_quantiles

MEASURES = ["lat", "thr", "loss"]

# fixed values: upper bound and name of each loss class
LOSS_CLASSES = [(2.0, "0_zero (<2%)"), (15.0, "1_low (2-15%)"), (50.0, "2_moderate (15-50%)"),
                (80.0, "3_high (50-80%)"), (None, "4_extreme (>80%)")]


def r6(c: Column) -> Column:
    return F.round(c, 6)


def share(cond: Column) -> Column:
    """Percentage of rows for which the condition holds."""
    return r6(F.avg(cond.cast("double")) * 100)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, null where one side has no spread."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def quality_counts(kpi: DataFrame) -> DataFrame:
    """Out-of-range and missing values in one pass."""
    def bad(cond: Column, name: str) -> Column:
        return F.count(F.when(cond, 1)).alias(name)
    return kpi.agg(
        F.count("*").alias("n_rows"),
        bad((F.col("loss") < 0) | (F.col("loss") > 100), "loss_out_of_range"),
        bad(F.col("thr") < 0, "negative_throughput"),
        bad(F.col("lat") < 0, "negative_latency"),
        *[bad(F.col(m).isNull(), f"null_{m}") for m in MEASURES])


def dataset_profile(kpi: DataFrame) -> DataFrame:
    """Distinct ticks per scenario with the cells and slices seen in it.

    Ticks are made unique by a first aggregation, so no task holds a scenario's rows."""
    ticks = kpi.groupBy("scenario", "tick").agg(
        F.collect_set("gnb").alias("g"), F.collect_set("slice").alias("s"),
        F.count("*").alias("n"))
    return ticks.groupBy("scenario").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_ticks"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("g")))), ",")
        .alias("cells"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))), ",")
        .alias("slices"))


def describe(kpi: DataFrame, keys: list[str], measures: list[str] | None = None) -> DataFrame:
    """Count, mean, spread, extremes and quartiles of each measure, per group and overall."""
    long = kpi.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures or MEASURES]))
        .alias("m")).select(*keys, "m.*")
    # the overall rows are one more group level beside each group
    both = long.withColumn("level", F.explode(F.array(F.lit("group"), F.lit("all"))))
    both = both.select(
        "level", *[F.when(F.col("level") == "all", F.lit("*")).otherwise(F.col(k)).alias(k)
                   for k in keys], "measure", "value")
    by = [*keys, "measure"]
    moments = both.groupBy(*by).agg(
        F.count("value").alias("n"), r6(F.avg("value")).alias("mean"),
        r6(F.stddev_samp("value")).alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    quart = exact_quantiles(both, by, F.col("value"), {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quart.select(*by, *[r6(F.col(q)).alias(q) for q in
                                            ("q25", "q50", "q75")]), by)


def mean_loss_grains(kpi: DataFrame) -> DataFrame:
    """Mean loss by scenario, by cell and slice, and by all three, in one aggregation."""
    out = kpi.groupingSets(
        [["scenario"], ["gnb", "slice"], ["scenario", "gnb", "slice"]],
        "scenario", "gnb", "slice").agg(
        F.grouping_id().cast("bigint").alias("grain"), F.count("*").alias("n"),
        r6(F.avg("loss")).alias("mean_loss"))
    return out


def label_pivot(kpi: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Scenario rows by cell_slice columns. The column list is fixed, so no extra pass."""
    labels = [f"{c}_{s}" for c in dims.CELLS for s in dims.SLICES]
    return (kpi.withColumn("label", naming.label_of(F.col("gnb"), F.col("slice")))
            .groupBy("scenario").pivot("label", labels).agg(value.alias(name)))


def slice_pivot(kpi: DataFrame, by: str, value: Column) -> DataFrame:
    """One column per slice."""
    return kpi.groupBy(by).pivot("slice", dims.SLICES).agg(value)


def loss_class(loss: Column) -> Column:
    out = F
    for bound, name in LOSS_CLASSES:
        out = out.otherwise(F.lit(name)) if bound is None else out.when(loss < bound, F.lit(name))
    return out


def loss_classes(kpi: DataFrame) -> DataFrame:
    """Rows and share per slice and loss class."""
    counts = (kpi.groupBy("slice", loss_class(F.col("loss")).alias("loss_class"))
              .agg(F.count("*").alias("n")))
    total = counts.groupBy("slice").agg(F.sum("n").alias("all_n"))
    return counts.join(total, "slice").select(
        "slice", "loss_class", "n", r6(F.col("n") / F.col("all_n") * 100).alias("pct"))


def loss_class_table(kpi: DataFrame) -> DataFrame:
    """Rows per slice with one column per loss class, 0 where a class is empty."""
    names = [n for _, n in LOSS_CLASSES]
    codes = [n.split(" ")[0] for n in names]
    t = (kpi.withColumn("c", F.substring_index(loss_class(F.col("loss")), " ", 1))
         .groupBy("slice").pivot("c", codes).agg(F.count(F.lit(1))))
    return t.select("slice", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in codes])


def correlations(kpi: DataFrame) -> DataFrame:
    """Correlation of log latency, throughput and loss per slice, as rows."""
    v = {"log_latency": F.log1p("lat"), "throughput": F.col("thr"), "loss": F.col("loss")}
    pairs = list(combinations_with_replacement(v, 2))
    one = kpi.groupBy("slice").agg(*[correlation(v[a], v[b]).alias(f"{a}|{b}") for a, b in pairs])
    return one.select("slice", F.explode(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"),
                 r6(F.col(f"`{a}|{b}`")).alias("r")) for a, b in pairs])).alias("p")
    ).select("slice", "p.*")


def histogram(kpi: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins between the smallest and largest value of each slice."""
    vals = kpi.select("slice", value.alias("v"))
    ends = vals.groupBy("slice").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_no = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
    return (join_groups(vals, ends, ["slice"])
            .groupBy("slice", bin_no.cast("bigint").alias("bin"))
            .agg(F.count("*").alias("n"), r6(F.min("lo")).alias("lo"),
                 r6(F.min("hi")).alias("hi")))


def loss_histogram(kpi: DataFrame) -> DataFrame:
    """50 loss bins per slice with mean, median and the shares below 1 and above 60 %."""
    bins = histogram(kpi, F.col("loss"), 50)
    facts = kpi.groupBy("slice").agg(
        r6(F.avg("loss")).alias("mean"), share(F.col("loss") < 1).alias("pct_below_1"),
        share(F.col("loss") > 60).alias("pct_above_60"))
    med = exact_quantiles(kpi, ["slice"], F.col("loss"), {"median": 0.5})
    return bins.join(facts, "slice").join(
        med.select("slice", r6(F.col("median")).alias("median")), "slice")


def latency_histogram(kpi: DataFrame) -> DataFrame:
    """60 latency bins per slice, values above five times the limit put at that point."""
    lim = dims.limit_dim(kpi.sparkSession, "detect").select("slice", F.col("lat_max").alias("cap"))
    k = kpi.join(lim, "slice")
    bins = histogram(k, F.least(F.col("lat"), F.col("cap") * 5), 60)
    facts = k.groupBy("slice").agg(r6(F.avg("lat")).alias("mean"),
                                   share(F.col("lat") > F.col("cap")).alias("pct_above_limit"))
    return bins.join(facts, "slice")


def five_numbers(kpi: DataFrame) -> DataFrame:
    keys = ["gnb", "slice"]
    q = exact_quantiles(kpi, keys, F.col("loss"), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    ends = kpi.groupBy(*keys).agg(F.min("loss").alias("low"), F.max("loss").alias("high"))
    return ends.join(q.select(*keys, *[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3")]),
                     keys)


def readiness_checks(kpi: DataFrame) -> DataFrame:
    """The checklist before training as (check, ok) rows."""
    # one aggregation to (scenario, cell, slice); everything else is derived from its few rows
    cell = kpi.groupBy("scenario", "gnb", "slice").agg(
        F.count("*").alias("n"), F.sum("loss").alias("s"), F.avg("loss").alias("m"),
        F.count(F.when(F.col("lat").isNull() | F.col("thr").isNull() | F.col("loss").isNull(), 1))
        .alias("missing"),
        F.count(F.when(~F.col("loss").between(0, 100), 1)).alias("outside"))
    scen = cell.groupBy("scenario").agg(
        (F.sum("s") / F.sum("n")).alias("m"), F.max("m").alias("cell_max"),
        F.sum("missing").alias("missing"), F.sum("outside").alias("outside"),
        F.collect_set("gnb").alias("g"), F.collect_set("slice").alias("sl"))
    one = scen.agg(
        F.sum("missing").alias("missing"), F.sum("outside").alias("outside"),
        F.max((F.col("m") < 2).cast("int")).alias("some_zero"), F.max("cell_max").alias("top"),
        F.max(((F.col("m") > 15) & (F.col("m") < 60)).cast("int")).alias("some_mid"),
        F.size(F.array_distinct(F.flatten(F.collect_set("g")))).alias("n_g"),
        F.size(F.array_distinct(F.flatten(F.collect_set("sl")))).alias("n_s"),
        F.count("*").alias("n_sc"))
    checks = [("no_missing_values", F.col("missing") == 0),
              ("loss_in_0_100", F.col("outside") == 0),
              ("a_scenario_near_0", F.col("some_zero") == 1),
              ("a_cell_above_60", F.col("top") > 60),
              ("a_scenario_15_to_60", F.col("some_mid") == 1),
              ("three_cells", F.col("n_g") == 3),
              ("three_slices", F.col("n_s") == 3),
              ("has_sla_flag", F.lit("sla_ok" in kpi.columns)),
              ("twelve_scenarios", F.col("n_sc") == 12)]
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), c.alias("ok")) for n, c in checks])).alias("c")
    ).select("c.*")


def high_loss_cells(kpi: DataFrame, above: float = 60.0) -> DataFrame:
    return (kpi.groupBy("scenario", "gnb", "slice").agg(r6(F.avg("loss")).alias("mean_loss"))
            .filter(F.col("mean_loss") > above))


def latency_violations(kpi: DataFrame) -> DataFrame:
    """Share of late rows, largest and mean latency by slice and by scenario, cell, slice."""
    late = F.col("lat") > F.col("lat_max")
    return kpi.groupingSets(
        [["slice"], ["scenario", "gnb", "slice"]], "scenario", "gnb", "slice").agg(
        F.count("*").alias("n"), share(late).alias("violation_pct"),
        r6(F.avg("lat")).alias("mean_latency_ms"), F.max("lat").alias("max_latency_ms"),
        share(F.col("sla_ok")).alias("sla_ok_pct"))


def binary_loss(kpi: DataFrame) -> DataFrame:
    """Late flag under the relaxed mMTC limit, with its complement."""
    limit = S.relaxed_latency_limit(F.col("slice"), F.col("lat_max"))
    late = (F.col("lat") > limit).cast("double")
    return kpi.withColumns({"lat_limit": limit, "late": late, "is_valid": late == 0})


def optional_columns(df: DataFrame) -> DataFrame:
    """Live rows with whatever is missing filled in: limit from the slice, loss from the
    packet count, else no loss."""
    have = set(df.columns)
    if "lat_max" not in have:
        df = df.join(dims.limit_dim(df.sparkSession, "detect").select("slice", "lat_max"), "slice")
    if "pkt_loss_pct" not in have:
        loss = (F.when(F.col("pkt_count") > 0, 0.0).otherwise(1.0) if "pkt_count" in have
                else F.lit(0.0))
        df = df.withColumn("pkt_loss_pct", loss)
    return df

