"""Linear systems solved in expressions, and the Huber forecaster by reweighted normal sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.operators.joins import join_groups
from slicewise.sinks.tables import landed

#: Standardised residual from which the loss grows linearly, penalty per row, rounds at most, and the
#: largest entry of the gradient per row at which a fit counts as done; rounds with quick steps.
DELTA, RIDGE, ROUNDS, TOLERANCE = 1.0, 1e-4, 60, 1e-8
QUICK = 20


def solve_system(matrix: Column, n: int, floor: float = 1e-12) -> Column:
    """Solution of ``n`` equations given as rows [a_i1 .. a_in, b_i]: elimination folded over the
    columns of an array of arrays. Of a column whose pivot is not above ``floor`` times its
    diagonal entry the unknown is 0. Without pivoting: meant for symmetric positive matrices."""
    start = F.struct(matrix.alias("m"), matrix.alias("given"))

    def column(acc: Column, k: Column) -> Column:
        m = acc["m"]
        pivot = F.get(F.get(m, k), k)
        usable = F.abs(pivot) > floor * F.abs(F.get(F.get(acc["given"], k), k))
        lead = F.get(m, k)

        def row(r: Column, i: Column) -> Column:
            out = F.transform(F.arrays_zip(r.alias("x"), lead.alias("p")), lambda c: F.when(i == k, c["x"] / pivot).otherwise(
                c["x"] - F.get(r, k) / pivot * c["p"]))
            none = F.when(i == k, F.transform(r, lambda x: x * 0.0)).otherwise(r)
            return F.when(usable, out).otherwise(none)

        return F.struct(F.transform(m, row).alias("m"), acc["given"].alias("given"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, column, lambda acc: acc["m"])
    return F.transform(done, lambda r: F.get(r, n))


def standardised(rows: DataFrame, columns: list[str], train: Column, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with columns scaled to mean 0 and spread 1 of the rows where ``train`` holds, and the
    scale (``m_<column>``, ``s_<column>``) by key. A constant column gets spread 1."""
    scale = landed(rows.filter(train).groupBy(*keys).agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.when(F.stddev_pop(c) > 1e-12, F.stddev_pop(c)).otherwise(1.0).alias(f"s_{c}") for c in columns]), "scale")
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in columns}
    return join_groups(rows, scale, keys).withColumns(z).drop(*[f"{p}_{c}" for c in columns for p in "ms"]), scale


def _predicted(features: list[str], k: int) -> Column:
    w = F.col("w")[k]
    out = w[len(features)]
    for i, f in enumerate(features):
        out = out + w[i] * F.col(f)
    return out


def huber_fit(train: DataFrame, features: list[str], targets: list[str], keys: list[str], delta: float = DELTA,
              ridge: float = RIDGE, rounds: int = ROUNDS) -> DataFrame:
    """``keys, n, w, gradient``: coefficients of the linear fits with the Huber loss, one array (features,
    constant) per target, and the largest entry of the gradient per row at ``w``.

    A round weighs a row by delta / residual beyond delta and solves the weighted normal equations,
    which never makes the loss larger. Every other of the first rounds takes rows beyond delta as
    a constant pull instead, which ends the search once it is known which rows these are. The
    sums, for all keys and targets at once, are one aggregate with map-side combine, so a key
    with most of the rows costs no more than others. Rounds end when all gradients are nil, or
    after ``rounds``. ``train`` is read once a round: hand in a landed table."""
    d = len(features) + 1
    x = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    nil = F.array(*[F.array(*[F.lit(0.0)] * d)] * len(targets))
    now = landed(train.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("w", nil), "huber")
    for turn in range(rounds):
        pull = turn % 2 == 1 and turn < QUICK
        rows = join_groups(train, now.select(*keys, "w"), keys)
        rest = {f"r{k}": F.col(t) - _predicted(features, k) for k, t in enumerate(targets)}
        near = lambda k: F.abs(F.col(f"r{k}")) <= delta
        weigh = {f"q{k}": F.when(near(k), 1.0).otherwise(0.0 if pull else delta / F.abs(F.col(f"r{k}")))
                 for k in range(len(targets))}
        to = lambda k, t: (F.when(near(k), F.col(t)).otherwise(F.signum(F.col(f"r{k}")) * delta) if pull
                           else F.col(f"q{k}") * F.col(t))
        sums = rows.withColumns(rest).withColumns(weigh).groupBy(*keys).agg(*[
            a for k, t in enumerate(targets) for a in [
                *[F.sum(F.col(f"q{k}") * x[i] * x[j]).alias(f"a{k}_{i}_{j}") for i in range(d) for j in range(i, d)],
                *[F.sum(to(k, t) * x[i]).alias(f"b{k}_{i}") for i in range(d)]]])
        penal = lambda i, j: F.col("n") * ridge if i == j < d - 1 else F.lit(0.0)
        entry = lambda k, i, j: F.col(f"a{k}_{min(i, j)}_{max(i, j)}") + penal(i, j)
        system = [F.array(*[F.array(*[entry(k, i, j) for j in range(d)], F.col(f"b{k}_{i}")) for i in range(d)])
                  for k in range(len(targets))]
        # at the old coefficients the equations, weighted or pulled, are the gradient
        slope = F.greatest(*[F.abs(sum((entry(k, i, j) * F.col("w")[k][j] for j in range(d)), F.lit(0.0)) - F.col(f"b{k}_{i}"))
                             for k in range(len(targets)) for i in range(d)]) / F.col("n")
        step = landed(sums.join(now, keys).select(
            *keys, "n", "w", slope.alias("gradient"), F.array(*[solve_system(m, d) for m in system]).alias("next")), "huber")
        worst = step.agg(F.max("gradient")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
        now = step.select(*keys, "n", F.col("next").alias("w"))
    return step.select(*keys, "n", "w", "gradient")


def predict(rows: DataFrame, fits: DataFrame, features: list[str], targets: list[str], keys: list[str]) -> DataFrame:
    """Adds ``p_<target>`` in the units of the standardised targets."""
    j = join_groups(rows, fits.select(*keys, "w"), keys)
    return j.withColumns({f"p_{t}": _predicted(features, k) for k, t in enumerate(targets)}).drop("w")
