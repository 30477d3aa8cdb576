"""How corpus filters interact: what each one removes in every order in which they can be applied.

Every document gets the set of filters that it fails, as bits of a number. The duplicate filter is an
existential self-join: a document fails it if a left-semi join on hash and exact text finds a
smaller doc_id. Its ids are united with the ids of the other failures, the bits are summed up per
document, and equal combinations are counted. Everything about orders follows from these counts:
a document falls at the first filter of the order that it fails.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewise.llm.common import row_key
from slicewise.operators.joins import join_small
from slicewise.sinks.tables import landed

#: The letter of the duplicate filter; the others are conditions on one text (see ``text_rules``).
DUPLICATE = "E"
#: Rows of one hash that are compared in one task (about).
SLOT_ROWS = 1000


def words(text: Column) -> Column:
    """Maximal runs of characters that are no ASCII blanks."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_rules(text: Column, found: Column) -> dict[str, Column]:
    """Failure conditions of the filters on one text, by letter; ``found`` are its words."""
    n = F.size(found)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200,
            "B": F.size(F.array_distinct(found)) * 100 < n * 50,
            "C": capitals * 100 > F.length(text) * 3,
            "D": text.rlike("[#$%&*|]")}


def repeats(docs: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """The rows of ``docs`` (``id``, ``h``, ``text``, others) whose text a smaller id has too.

    Only rows whose hash occurs with two ids take part in the comparison of texts, and of equal
    texts only one, with the least id, stands on the right: it exists or it doesn't. The rows of a
    frequent hash are dealt to slots of about ``slot_rows``, and its texts stand in each of them."""
    twice = (docs.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
             .filter("lo < hi").select("h", F.ceil(F.col("n") / slot_rows).alias("slots")))
    able = join_small(docs, twice, ["h"])
    first = (able.groupBy(F.col("h").alias("eh"), F.col("text").alias("other"), "slots").agg(F.min("id").alias("least"))
             .select("eh", "other", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("at")))
    mine = able.withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")))
    return mine.join(first, (F.col("h") == F.col("eh")) & (F.col("text") == F.col("other")) & (F.col("slot") == F.col("at"))
                     & (F.col("least") < F.col("id")), "left_semi")


def failures(docs: DataFrame) -> DataFrame:
    """``id, part, mask, n``: numbers of documents by doc_id, lang and failed filters (bit 0: A).

    Null text counts as empty and is equal to an empty one; null lang is the part ''. A null doc_id
    is smaller than none, so it neither fails the duplicate filter nor makes others fail it. Rows
    with one doc_id are not smaller than each other; each counts as a document of its own."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"),
                       text.alias("text"))
    named = rows.select("id", "part", "text", F.xxhash64("text").alias("h"))
    judged = rows.select("id", "part", "text", words(F.col("text")).alias("words"))
    rules = text_rules(F.col("text"), F.col("words"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(rules.values())), F.lit(0))
    # rows that are equal in id and text fail the same filters: one key for all of them
    key = row_key(F.col("id"), F.col("text"))
    others = judged.select("id", key.alias("key"), "part", mask.cast("int").alias("mask"), F.lit(1).alias("n"))
    dup = repeats(named).select("id", key.alias("key"), "part", F.lit(1 << len(rules)).alias("mask"), F.lit(0).alias("n"))
    return (others.unionByName(dup).groupBy("id", "key", "part")
            .agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
            .groupBy("id", "part", "mask").agg(F.sum("n").alias("n")))


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n``: at most 128 rows a part. A document is good (toxic) if any
    label of its doc_id says quality 1 (toxic 1)."""
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (failures(docs).join(said, "id", "left").select("part", "mask", flag("good"), flag("toxic"), "n")
            .groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")))


def orders(docs: DataFrame, letters: str) -> DataFrame:
    """What happens to each combination at each step of each order: a constant table."""
    rows = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            rows += [("".join(order), step, letter, m, int(not m & (before | bit)), int(m & bit and not m & before),
                      int(m & bit and m & before > 0), int(m == bit)) for m in range(1 << len(letters))]
            before |= bit
    return docs.sparkSession.createDataFrame(
        rows, "filter_order string, step int, letter string, mask int, kept int, removed int, redundant int, alone int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per lang, order of the five filters and step: ``part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley``.

    All 120 orders of 5 steps are there for every lang, with zeros too. Whole texts are judged,
    however long; an empty table of documents has no parts and gives no rows; without labels nothing
    is good or toxic. Extra columns are not read. See ``failures`` for nulls, ties and repeated rows.
    """
    letters = "".join(text_rules(F.lit(""), F.array(F.lit("")))) + DUPLICATE
    found = landed(combinations(docs, labels), "audit-combinations")
    n = lambda flag, name: F.sum(F.col("n") * F.col(flag)).alias(name)
    lost = lambda flag: F.sum(F.col("n") * F.col("removed") * F.col(flag)).alias(f"{flag}_lost")
    steps = (found.join(F.broadcast(orders(docs, letters)), "mask").groupBy("part", "filter_order", "step", "letter")
             .agg(n("kept", "kept"), n("removed", "removed"), n("redundant", "redundant"),
                  n("alone", "unique_fails"), lost("good"), lost("toxic")))
    # 600 rows a part
    return (steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                    "good_lost", "toxic_lost", "shapley"))
