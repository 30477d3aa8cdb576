"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic) with token counts. Cell weights are raked to
target marginals of the three dimensions in turn until they are met to a tolerance. No cell can
give more than all its tokens: a cell that would have to is taken whole, and the others are raked
to what then remains of the marginals. A target beyond all tokens of its category is cut to them
first, and the rest goes to the other categories in proportion to their targets. A document's
calibrated probability is its cell's weight over the weight of the whole cell. Only the table of
cells is raked, as window sums over it: its size is the number of category combinations, not of
documents.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewise.llm.common import small
from slicewise.sinks.tables import landed

DIMS = ("source", "lang", "topic")
#: Production parameters: share of all tokens to sample, and the exponent that turns natural
#: marginals into targets (1 keeps them, 0 makes all categories equal).
SHARE, SEED = 0.5, "mix-1"
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Raking ends when no marginal is off by more than the tolerance; looked at after every block of
#: rounds. The last number of rounds is for targets that contradict each other.
TOLERANCE, BLOCK, ROUNDS = 1e-6, 2, 64
NONE = "(none)"
#: Fixed values. Marks of a text's topic, first match wins.
TOPIC_MARKS = [("markup", ("%%%", "***", "&&&", "$$$", "###")), ("table", ("|",)), ("shout", ("!!",)),
               ("contact", ("@", "+")), ("code", ("=", "{"))]
LONG_CHARS = 2000


def surface_topic(text: Column) -> Column:
    """A topic for corpora that bring none: what kind of text it is, told by marks in it."""
    text = F.coalesce(text, F.lit(""))
    out = F.when(F.lit(False), F.lit(""))
    for name, marks in TOPIC_MARKS:
        any_mark = F.lit(False)
        for m in marks:
            any_mark = any_mark | F.contains(text, F.lit(m))
        out = out.when(any_mark, F.lit(name))
    return out.otherwise(F.when(F.length(text) >= LONG_CHARS, "long").otherwise("short"))


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x09-\x0D\x20]+")), F.lit(0)).cast("long")


def _cell(topic: Column | None) -> list[Column]:
    """The three categories of a row; a null one is ``(none)``."""
    found = {"source": F.col("source"), "lang": F.col("lang"),
             "topic": surface_topic(F.col("text")) if topic is None else topic}
    return [F.coalesce(found[d], F.lit(NONE)).alias(d) for d in DIMS]


def described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``doc_id``, the cell and ``n_tokens`` of every row."""
    return docs.select("doc_id", *_cell(topic), token_count(F.col("text")).alias("n_tokens"))


def _target(cells: DataFrame, d: str, given: Mapping[str, float] | None, power: float, share: float | None) -> DataFrame:
    """``cells`` with ``t_<d>``: the target of the row's category in dimension ``d``."""
    total, by = Window.partitionBy(F.lit(0)), Window.partitionBy(d)
    out = cells.withColumn("s", F.sum("tokens").over(by).cast("double"))
    if given:
        t = F.lit(0.0)
        for name, weight in given.items():
            t = F.when(F.col(d) == name, float(weight)).otherwise(t)
    else:
        t = F.pow(F.col("s"), F.lit(float(power)))
    # each cell carries its part of the category, so that one sum adds all categories up
    out = (out.withColumn("t", t).withColumn("part", F.col("tokens") / F.col("s"))
           .withColumn("whole", F.sum(F.col("t") * F.col("part")).over(total))
           .withColumn("t", F.when(F.col("whole") > 0, F.col("t") / F.col("whole")).otherwise(0.0)))
    if share is None:
        return out.withColumnRenamed("t", f"t_{d}").drop("s", "part", "whole")
    # with the categories cut that can give least of their target, the others are raised by the
    # factor that fills the sample; the right cut is the one with the largest factor
    out = out.withColumn("most", F.col("s") / (F.sum("tokens").over(total) * share))
    run = (Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("t") > 0, F.col("most") / F.col("t")).asc_nulls_last(), *DIMS)
           .rowsBetween(Window.unboundedPreceding, 0))
    left = 1 - F.col("cut_t")
    return (out.withColumn("cut", F.sum(F.col("most") * F.col("part")).over(run))
            .withColumn("cut_t", F.sum(F.col("t") * F.col("part")).over(run))
            .withColumn("up", F.greatest(F.lit(1.0), F.max(F.when(left > 1e-9, (1 - F.col("cut")) / left)).over(total)))
            .withColumn(f"t_{d}", F.least("most", F.col("up") * F.col("t")))
            .drop("s", "t", "part", "whole", "most", "cut", "cut_t", "up"))


def _raked(cells: DataFrame, d: str) -> DataFrame:
    """One step: ``u`` of the cells of a category is scaled so that least(u, cap) sums up to the
    target if the same cells stay cut."""
    by, t, u, cap = Window.partitionBy(d), F.col(f"t_{d}"), F.col("u"), F.col("cap")
    cut, free = F.col("cut"), F.col("free")
    return (cells.withColumn("cut", F.sum(F.when(u >= cap, cap).otherwise(0.0)).over(by))
            .withColumn("free", F.sum(F.when(u >= cap, 0.0).otherwise(u)).over(by))
            .withColumn("u", F.when((t > cut) & (free > 0), u * (t - cut) / free).when(t >= cut, u)
                        .otherwise(F.least(u, cap) * t / (cut + free))).drop("cut", "free"))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None,
         temper: Mapping[str, float] = TEMPER, share: float | None = None, tolerance: float = TOLERANCE,
         rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (the dimensions and ``tokens`` > 0) with ``weight``, the raked share of each cell,
    and the target marginals ``t_<dimension>`` of its categories.

    ``targets`` gives a dimension's marginals by category (scaled to sum 1; categories that are
    not listed get nothing); a dimension without targets gets its natural marginal to the power
    ``temper``. With ``share`` a sample of that share of all tokens is to have these marginals: no
    weight then exceeds what the whole cell is of the sample. Rounds go over the dimensions in turn
    until every marginal is met to ``tolerance``. Targets that contradict each other, each within
    reach alone, end after ``rounds`` with the last dimension met as far as its cells go.
    """
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    out = cells.withColumn("u", F.col("tokens") / total).withColumn(
        "cap", F.lit(float("inf")) if share is None else F.col("tokens") / (total * share))
    for d in DIMS:
        out = _target(out, d, (targets or {}).get(d), temper[d], share)
    out = landed(out, "mix-start")
    weight = F.least("u", "cap").alias("weight")
    for done in range(0, rounds, BLOCK):
        for _ in range(min(BLOCK, rounds - done)):
            for d in DIMS:
                out = _raked(out, d)
        out = landed(out, "mix-raked")
        off = out.select(*[F.abs(F.sum(weight).over(Window.partitionBy(d)) - F.col(f"t_{d}")).alias(d) for d in DIMS])
        worst = off.agg(F.max(F.greatest(*DIMS)).alias("x")).first()["x"]
        if worst is None or worst <= tolerance:
            break
    return out.select(*DIMS, "tokens", weight, *[f"t_{d}" for d in DIMS])


def rates(parts: DataFrame, share: float = SHARE, **raking) -> DataFrame:
    """Per cell ``tokens``, the targets, ``ratio`` (weight of a token against its natural weight)
    and the sampling probability ``p``, ``share`` times the ratio. Where p is 1 the sample holds
    all of the cell."""
    cells = landed(parts.filter(F.col("n_tokens") > 0).groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")),
                   "mix-cells")
    natural = F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    out = rake(cells, share=share, **raking).withColumn("ratio", F.col("weight") / natural)
    return landed(out.select(*DIMS, "tokens", *[f"t_{d}" for d in DIMS], F.round("ratio", 9).alias("ratio"),
                             F.round(F.least(F.lit(1.0), F.col("ratio") * share), 9).alias("p")), "mix-rates")


def balance(docs: DataFrame, topic: Column | None = None, share: float = SHARE, **raking) -> DataFrame:
    """``dimension, category, natural, target, expected``: every marginal of the corpus, as asked
    for (cut to what there is) and as expected of the sample, in shares of all its tokens."""
    rate = rates(described(docs, topic), share, **raking)
    sides = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category"),
                                         F.col(f"t_{d}").alias("target")) for d in DIMS])).alias("at")
    total = Window.partitionBy("dimension")
    by = (rate.select("tokens", "p", sides).groupBy("at.dimension", "at.category")
          .agg(F.sum("tokens").alias("all"), F.max("at.target").alias("target"),
               F.sum(F.col("tokens") * F.col("p")).alias("drawn")))
    return by.select("dimension", "category", (F.col("all") / F.sum("all").over(total)).alias("natural"), "target",
                     (F.col("drawn") / F.sum("drawn").over(total)).alias("expected"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed and id: the same in every run and retry."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("-")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def plan(docs: DataFrame, topic: Column | None = None, share: float = SHARE, **raking) -> DataFrame:
    """One row per row of ``docs``: doc_id, cell, n_tokens, ``ratio`` (weight of a token
    against its natural weight), ``p`` and ``sampled``.

    Rows without tokens (null, empty, blank texts) carry no weight: ratio and p are 0 and they are
    never sampled. Rows with one doc_id are sampled together, null ids too; repeated rows count
    with all their tokens; an empty table gives an empty one; other columns are not read.
    """
    parts = landed(described(docs, topic), "mix-parts")
    rate = rates(parts, share, **raking)
    out = parts.join(small(rate.select(*DIMS, "ratio", "p"), rate.count() * 4), list(DIMS), "left")
    some = F.col("n_tokens") > 0
    p = F.when(some, F.coalesce("p", F.lit(0.0))).otherwise(0.0)
    return out.select("doc_id", *DIMS, "n_tokens",
                      F.when(some, F.coalesce("ratio", F.lit(0.0))).otherwise(0.0).alias("ratio"),
                      p.alias("p"), (uniform(F.col("doc_id")) < p).alias("sampled"))


def sample(docs: DataFrame, topic: Column | None = None, share: float = SHARE, **raking) -> DataFrame:
    """The rows of ``docs`` that are sampled, with all their columns (cases as in ``plan``)."""
    rate = rates(landed(described(docs, topic), "mix-parts"), share, **raking)
    held = docs.select(F.struct("*").alias("row"), *_cell(topic), uniform(F.col("doc_id")).alias("u"),
                       token_count(F.col("text")).alias("n"))
    return (held.join(small(rate.select(*DIMS, "p"), rate.count() * 4), list(DIMS))
            .filter((F.col("n") > 0) & (F.col("u") < F.col("p"))).select("row.*"))
