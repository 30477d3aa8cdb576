"""Exact top-k search by inner product as a Voronoi join.

Larger inner product means smaller distance once every data vector x is lifted to
(x, sqrt(M - |x|^2)) and every query q to (q, 0), with M the largest squared norm:
|q' - x'|^2 = |q|^2 + M - 2 q.x. In that space queries and data are dealt to the cells of common
pivots. Per cell only a summary leaves the executors (count, radius, the k + 1 smallest distances).
From the summaries follows, for each cell of queries, a radius that is sure to hold its k nearest
rows, and with it the distances from each data pivot that can matter; only such rows are sent to
the group of that query cell, in blocks of bounded size, and searched there. Scores are exact
integers; the lifted distances only prune, with a margin for rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewise.sinks.tables import landed

#: Pivots at most; the driver holds this many vectors and their summaries, whatever the input.
PIVOTS = 96
#: Queries in a group at most (about), and data rows in a block (about).
GROUP_QUERIES, BLOCK_ROWS = 2048, 16384
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = 1024, vec: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, each component floor(scale * x) with x as double. Vectors that are
    null, empty or hold a null or non-finite component are left out, as are null ids."""
    x = F.transform(F.col(vec), lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col(vec).isNotNull()
                           & (F.size(vec) > 0) & F.coalesce(good, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c * scale)).alias("v")))


def _norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column])


def _cells(df: DataFrame, pivots: np.ndarray, top: float, lift: bool) -> DataFrame:
    """Adds the nearest pivot's number and the distance to it, in the lifted space."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) == 0:
                continue
            x = _matrix(b["v"])
            own = (x * x).sum(1)
            last = np.sqrt(np.maximum(top - own, 0.0)) if lift else np.zeros(len(x))
            at = np.column_stack([x, last])
            d2 = (at * at).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * at @ pivots.T
            cell = d2.argmin(1)
            away = np.linalg.norm(at - pivots[cell], axis=1)
            yield b.assign(cell=cell.astype(np.int32), away=away)

    return df.mapInPandas(assign, "vec_id long, v array<bigint>, cell int, away double")


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles while every partial sum is below 2**53, else integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if bound < 2.0 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if bound < 2.0 ** 62:
        return q @ x.T
    return np.array([[sum(int(a) * int(b) for a, b in zip(r, s)) for s in x] for r in q], dtype=object)


def _search(k: int):
    def local(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if len(queries) == 0 or len(data) == 0:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        ids = data["vec_id"].to_numpy(np.int64)
        x = np.stack([np.asarray(r, dtype=np.int64) for r in data["v"]])
        out = []
        for lo in range(0, len(queries), 256):
            part = queries.iloc[lo:lo + 256]
            scores = _dot(np.stack([np.asarray(r, dtype=np.int64) for r in part["v"]]), x)
            for own, row in zip(part["vec_id"].to_numpy(np.int64), scores):
                able = np.flatnonzero(ids != own)
                if len(able) > k:
                    s = row[able]
                    cut = np.partition(s, len(s) - k)[len(s) - k]
                    able = able[s >= cut]
                best = able[np.lexsort((ids[able], -row[able]))][:k]
                out.append((np.full(len(best), own), ids[best], row[best].astype(np.int64)))
        return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]),
                             "vec_id": np.concatenate([o[1] for o in out]),
                             "score": np.concatenate([o[2] for o in out])})
    return local


def top_k(queries: DataFrame, data: DataFrame, k: int = 10, pivots: int = PIVOTS,
          group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of every query over
    the rows of ``data`` with another id, ties to the smaller id; all rows if there are fewer.

    Both inputs hold ``vec_id long`` and ``v array<bigint>`` of one length (see
    ``integer_vectors``). An id names one vector on both sides: of several the least. Vectors of
    another length than most of ``data`` have are left out, on both sides. Of equal vectors
    only those with the k + 1 smallest ids can be among the results, so the others stay behind
    before anything is sent; results are the same. Empty inputs give an empty result.
    """
    spark = data.sparkSession
    same = Window.partitionBy("v").orderBy("vec_id")
    data, queries = (df.groupBy("vec_id").agg(F.min("v").alias("v")) for df in (data, queries))
    sizes = data.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    whole = F.size("v") == (sizes["d"] if sizes else 0)
    data = (data.filter(whole)
            .withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1)
            .select("vec_id", "v"))
    data = landed(data, "knn-data")
    queries = landed(queries.filter(whole), "knn-queries")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top = data.agg(F.max(_norm2(F.col("v")))).first()[0]
    n_queries = queries.count()
    if top is None or n_queries == 0:
        return empty

    # pivots: a bounded sample by hash, from the data and from the queries
    def sample(df: DataFrame, n: int) -> list:
        return [r["v"] for r in df.select("v").orderBy(F.xxhash64("v"), "vec_id").limit(n).collect()]

    picked = np.unique(np.array(sample(data, pivots), dtype=np.float64), axis=0)
    lifted = np.column_stack([picked, np.sqrt(np.maximum(top - (picked ** 2).sum(1), 0.0))])
    asked = np.unique(np.array(sample(queries, pivots), dtype=np.float64), axis=0)
    centres = np.column_stack([asked, np.zeros(len(asked))])

    xs = landed(_cells(data, lifted, top, True), "knn-cells")
    qs = landed(_cells(queries, centres, top, False), "knn-query-cells")
    near = Window.partitionBy("cell").orderBy("away")
    firsts = (xs.select("cell", "away").withColumn("r", F.row_number().over(near))
              .filter(F.col("r") <= k + 1).groupBy("cell").agg(F.sort_array(F.collect_list("away")).alias("low")))
    summary = {r["cell"]: r for r in xs.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("away").alias("far")).join(firsts, "cell").collect()}
    asks = {r["cell"]: r for r in qs.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("away").alias("far")).collect()}

    # neighbouring query cells share a group; a cell that alone exceeds it is dealt into parts
    groups, held, group = {}, 0, 0
    for c in sorted(asks, key=lambda c: tuple(centres[c])):
        if held and held + asks[c]["n"] > group_queries:
            group, held = group + 1, 0
        groups[c], held = group, held + asks[c]["n"]
    parts = {g: -(-sum(asks[c]["n"] for c in asks if groups[c] == g) // group_queries)
             for g in groups.values()}

    # per query cell a radius that holds k + 1 rows; per data cell the distances that reach it
    ranges: dict = {}
    for c, g in groups.items():
        between = {j: float(np.linalg.norm(centres[c] - lifted[j])) for j in summary}
        ahead = sorted(asks[c]["far"] + between[j] + a for j in summary for a in summary[j]["low"])
        reach = ahead[k] if len(ahead) > k else math.inf
        for j in summary:
            slack = 1e-6 * (1.0 + between[j] + asks[c]["far"] + math.sqrt(top))
            low = between[j] - asks[c]["far"] - reach - slack
            high = between[j] + asks[c]["far"] + reach + slack
            if low <= summary[j]["far"]:
                a, b = ranges.get((g, j), (math.inf, -math.inf))
                ranges[g, j] = (min(a, low), max(b, high))
    blocks = {g: max(1, -(-sum(summary[j]["n"] for h, j in ranges if h == g) // block_rows))
              for g in parts}
    # at most pivots**2 rules and pivots seats of a few numbers each
    rule = F.broadcast(spark.createDataFrame(
        [(g, j, a, b, blocks[g], parts[g]) for (g, j), (a, b) in ranges.items()],
        "grp int, cell int, low double, high double, blocks int, parts int"))
    seats = F.broadcast(spark.createDataFrame(
        [(c, g, blocks[g], parts[g]) for c, g in groups.items()],
        "cell int, grp int, blocks int, parts int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    sent = (xs.join(rule, "cell").filter(F.col("away").between(F.col("low"), F.col("high")))
            .select("grp", each("parts").alias("part"), deal("blocks").alias("block"), "vec_id", "v"))
    asked_rows = (qs.join(seats, "cell")
                  .select("grp", deal("parts").alias("part"), each("blocks").alias("block"),
                          "vec_id", "v"))
    keys = ["grp", "part", "block"]
    found = (asked_rows.groupBy(*keys).cogroup(sent.groupBy(*keys))
             .applyInPandas(_search(k), FOUND))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
