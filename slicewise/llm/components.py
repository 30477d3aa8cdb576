"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.sinks.tables import landed


def _contract(links: DataFrame, large: bool) -> DataFrame:
    """One star step. ``large``: every larger neighbour of u is linked to the least of u and its
    neighbours; else u and its smaller neighbours are linked to the least of them. The least is
    an aggregate joined back, so a hub's links are never gathered in one place."""
    both = links.select("a", "b")
    if large:
        both = both.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                              F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
                                              )).alias("e")).select("e.a", "e.b")
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``, comparable, not null):
    root is the least node that can be reached. Links to oneself and repeated links do no harm;
    an empty table gives an empty one. Every round is written to the shared folder."""
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = landed(links.filter(F.col("a") != F.col("b")).select(larger, smaller).distinct(), "links")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            break
        state = seen
        now = landed(_contract(_contract(now, True), False), "links")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b"), F.col("b")).distinct())
