"""Model parameters across cells: averaging, drift, local and proximal fits, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewise.operators.joins import join_groups
from slicewise.operators.robust import solve_system
from slicewise.operators.series import running_sums
from slicewise.sinks.tables import landed

PROXIMAL_MU = 0.01
#: Draws that meet in one bucket, and rows of a group that one task may rank (about).
BUCKET, NARROW = 500, 20000


def federated_average(params: DataFrame, by: tuple[str, ...] = ("slice", "param", "idx"),
                      value: str = "value") -> DataFrame:
    """Unweighted mean of every parameter over the cells."""
    return params.groupBy(*by).agg(F.avg(value).alias(value), F.count("*").alias("n_cells"))


def parameter_drift(params: DataFrame) -> DataFrame:
    """Distance from the initial to the final parameters per (slice, cell)."""
    d = F.col("final") - F.col("initial")
    return params.groupBy("slice", "gnb").agg(F.sqrt(F.sum(d * d)).alias("l2"))


def drift_of_all(vectors: DataFrame) -> DataFrame:
    """Mean distance of all vectors of a (slice, cell) from its first one, each taken in its row."""
    first = vectors.groupBy("slice", "gnb").agg(F.min_by("embedding", "vec_id").alias("_first"))
    gap = F.zip_with("embedding", "_first", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0)))
    length = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))
    return (join_groups(vectors, first, ["slice", "gnb"]).groupBy("slice", "gnb")
            .agg(F.count("*").alias("n_vectors"), F.avg(length).alias("l2_mean")))


def divergence(params: DataFrame, value: str = "final") -> DataFrame:
    """Sum over tensors of the distance of every other cell to a slice's first cell."""
    first = params.groupBy("slice").agg(F.min("gnb").alias("ref_gnb"))
    ref = (params.join(first, "slice").filter(F.col("gnb") == F.col("ref_gnb"))
           .select("slice", "param", "idx", "ref_gnb", F.col(value).alias("ref")))
    d = F.col(value) - F.col("ref")
    per_tensor = (params.join(ref, ["slice", "param", "idx"])
                  .filter(F.col("gnb") != F.col("ref_gnb"))
                  .groupBy("slice", "gnb", "param").agg(F.sqrt(F.sum(d * d)).alias("norm")))
    return per_tensor.groupBy("slice").agg(F.sum("norm").alias("divergence"))


def normal_sums(rows: DataFrame, features: list[str], target: str,
                keys: tuple[str, ...] = ("slice", "gnb")) -> DataFrame:
    """Entries of X'X and X'y per key, long form (key, i, j, value, n); column ``d`` of X is the
    constant and j = d + 1 holds X'y.

    One aggregate with a sum per entry: every map task sends one row per key, so a cell with most
    of the rows costs no more than others. A null key is a key like others.
    """
    d = len(features)
    x = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    y = F.col(target).cast("double")
    half = {(i, j): F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)}
    ends = [F.sum(x[i] * y).alias(f"y{i}") for i in range(d + 1)]
    wide = rows.groupBy(*keys).agg(F.count("*").alias("n"), *half.values(), *ends)
    entries = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                        F.col(f"y{i}" if j == d + 1 else f"x{min(i, j)}_{max(i, j)}").alias("value"))
               for i in range(d + 1) for j in range(d + 2)]
    return wide.select(*keys, "n", F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*", "n")


def solve(sums: DataFrame, d: int, keys: tuple[str, ...] = ("slice", "gnb"),
          mu: float = 0.0) -> DataFrame:
    """Parameters (key, idx, value) from the sums, by elimination in expressions. A group is one
    matrix of (d+1)(d+2) entries. With ``mu`` the rows also carry ``centre`` (the average
    parameters by i) and the fit is drawn toward it. Sums are taken per row so that ``mu`` does
    not depend on the number of rows. A feature that others determine gets 0."""
    centre = F.col("centre") if mu else F.lit(0.0)
    wide = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "j", "value", centre.alias("centre")))).alias("e"),
                                   F.greatest(F.max("n"), F.lit(1)).alias("n"))

    def entry(i: Column, j: Column) -> Column:
        at = F.get("e", i * (d + 2) + j)
        drawn = F.when(j == d + 1, at["centre"] * mu).when(i == j, mu).otherwise(0.0)
        return at["value"] / F.col("n") + drawn

    count = lambda n: F.sequence(F.lit(0), F.lit(n))
    matrix = F.transform(count(d), lambda i: F.transform(count(d + 1), lambda j: entry(i, j)))
    return wide.select(*keys, F.posexplode(solve_system(matrix, d + 1)).alias("idx", "value")).withColumn(
        "idx", F.col("idx").cast("bigint"))


def federated_fit(sums: DataFrame, d: int, mu: float = PROXIMAL_MU) -> DataFrame:
    """Local fit per cell, average over the cells of a slice, refit toward the average.
    ``sums`` comes from ``normal_sums``; it is used twice, so hand in a landed table."""
    local = solve(sums, d)
    avg = local.groupBy("slice", "idx").agg(F.avg("value").alias("centre"))
    near = solve(sums.join(avg.withColumnRenamed("idx", "i"), ["slice", "i"]), d, mu=mu)
    return (local.withColumnRenamed("value", "local")
            .join(near.withColumnRenamed("value", "proximal"), ["slice", "gnb", "idx"])
            .join(avg.withColumnRenamed("centre", "average"), ["slice", "idx"]))


def weighted_sample(windows: DataFrame, seed: int = 42,
                    keys: tuple[str, ...] = ("slice", "scenario", "gnb", "start")) -> DataFrame:
    """Sampling with replacement in proportion to ``weight`` within each slice: exactly as many draws
    as the slice has windows, one row each, numbered ``draw``.

    Weights are taken in millionths, so their running sums are exact. Draw i of a slice is a hash of
    seed, slice and i, a number below the slice's sum, and takes the window in whose stretch it
    falls. Stretches and draws meet in buckets of about ``BUCKET`` draws; a heavy window stands in
    several. The draws repeat in every run and retry. Weights must not be negative."""
    more = tuple(k for k in keys if k in windows.columns and k not in ("slice", "start"))
    whole = windows.withColumn("_w", F.round(F.col("weight") * 1e6).cast("bigint"))
    placed = landed(running_sums(whole, ["slice"], "start", {"_hi": F.col("_w"), "_i": F.lit(1).cast("bigint")}, more),
                    "weights")
    width = F.greatest(F.ceil(F.col("_hi_total") / F.ceil(F.col("_i_total") / BUCKET)), F.lit(1)).cast("bigint")
    bucket = lambda c: F.floor(c / F.col("_width")).cast("bigint")
    rows = placed.withColumns({"_width": width, "_lo": F.col("_hi") - F.col("_w")}).filter("_hi_total > 0")
    drawn = F.pmod(_hash_number(F.concat_ws("|", F.lit(str(seed)), "slice", F.col("_i").cast("string"))), F.col("_hi_total"))
    draws = rows.select("slice", F.col("_i").alias("draw"), drawn.alias("_v"), "_width").withColumn("_b", bucket(F.col("_v"))).drop("_width")
    # the most draws of one bucket lie in one stretch at worst: those are rows to be made anyway
    spread = (rows.filter("_w > 0").withColumn("_b", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi") - 1))))
              .drop("_i", "_i_total", "_hi_total", "_width", "_w"))
    return (spread.join(draws, ["slice", "_b"]).filter((F.col("_lo") <= F.col("_v")) & (F.col("_v") < F.col("_hi")))
            .drop("_b", "_lo", "_hi", "_v"))


def _hash_number(text: Column) -> Column:
    """52 bits of a hash."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def split_parts(rows: DataFrame, keys: list[str], val_share: float = 0.15,
                by: tuple[str, ...] = ("slice",), narrow: int = NARROW, bits: int = 12) -> DataFrame:
    """Random but repeatable parts: in every group of ``by`` exactly int(val_share * n) rows are
    ``val``, those whose hash of ``keys`` is least; the rest are ``train``. Keys name the rows.

    The hash at which a group is cut is found by counting: the rows of each of 2**bits stretches of
    hashes, then those of the stretch in which the cut lies, until it holds few rows, and only
    these are ranked. So no task ranks more than ``narrow`` rows, whatever a group holds."""
    named = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])
    rows = landed(rows.withColumn("_h", _hash_number(named)), "split")
    cut = landed(rows.groupBy(*by).agg(F.floor(F.count("*") * F.lit(val_share)).cast("bigint").alias("_left"),
                                       F.lit(0).cast("bigint").alias("_lo"), F.count("*").alias("_held")), "split-cut")
    shift = 52
    while shift > 0 and (cut.agg(F.max("_held")).first()[0] or 0) > narrow:
        step = max(shift - bits, 0)
        at = F.floor((F.col("_h") - F.col("_lo")) / F.lit(float(1 << step))).cast("bigint")
        inside = (F.col("_h") >= F.col("_lo")) & (F.col("_h") < F.col("_lo") + F.lit(1 << shift))
        counts = (join_groups(rows, cut, list(by)).filter(inside).groupBy(*by, "_left", "_lo", at.alias("_at"))
                  .agg(F.count("*").alias("_held")))
        upto = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)      # 2**bits rows
        below = counts.withColumn("_below", F.coalesce(F.sum("_held").over(upto), F.lit(0)))
        last = F.greatest(F.col("_left") - 1, F.lit(0))                     # the last one before the cut
        hit = below.filter((F.col("_below") <= last) & (last < F.col("_below") + F.col("_held")))
        cut = landed(hit.select(*by, (F.col("_left") - F.col("_below")).alias("_left"),
                                (F.col("_lo") + F.col("_at") * F.lit(1 << step)).alias("_lo"), "_held"), "split-cut")
        shift = step
    j = join_groups(rows, cut.drop("_held"), list(by)).withColumn("_top", F.col("_lo") + F.lit(1 << shift))
    close = (F.col("_h") >= F.col("_lo")) & (F.col("_h") < F.col("_top"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h", *keys))
    near = j.filter(close).withColumn("part", F.when(rank <= F.col("_left"), "val").otherwise("train"))
    far = j.filter(~close).withColumn("part", F.when(F.col("_h") < F.col("_lo"), "val").otherwise("train"))
    return near.unionByName(far).drop("_h", "_lo", "_left", "_top")
