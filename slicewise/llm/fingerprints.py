"""Document fingerprints by SimHash, and the search for all that are near, in DataFrame functions.

Every word of a text is a term; its hash votes on 64 signed bits with the word's length as weight, so
that long words, which tell texts apart, count more than short ones, which all texts share. A bit is
one if the weight of the ones exceeds that of the zeros. Words are rows only between an explode and
the aggregate behind it, in generated code and in one stage: the votes of four bits stand in 16-bit
lanes of one long, so a word costs 16 additions.

Near fingerprints are found by permuted block tables: the bits are cut into more than ``radius``
blocks; two fingerprints that differ in at most ``radius`` bits agree in all blocks but ``radius``, so
each choice of the other blocks is a table keyed by them. A pair is taken from the first of its
tables only, so nothing has to be made distinct, and counts need no pair to be kept.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewise.llm.common import ascii_lower
from slicewise.operators.joins import join_small
from slicewise.sinks.tables import landed

BITS, RADIUS = 64, 3
#: Longest weight of a word, and words whose votes fit in the lanes: 15 * 2048 < 32768, as the
#: highest lane has the sign.
WEIGHT, WORDS = 15, 2048
#: Characters in a range of documents (about) that are put in order by one task.
RANGE_CHARS = 1 << 24
#: Fingerprints of a table's key that are compared in one task (about).
SLOT_ROWS = 2000
_SPREAD, _LANES = 0x0000200040008001, 0x0001000100010001


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the angle that the share of differing bits estimates, 0 from a right angle on."""
    apart = F.bit_count(a.bitwiseXOR(b))
    return F.when(apart >= BITS // 2, 0.0).otherwise(F.cos(apart * (math.pi / BITS)))


def _wide(lane: Column, low: int) -> Column:
    """Two of the four 16-bit lanes of a long, in 32-bit lanes."""
    at = lambda s: F.shiftright(lane, 16 * s).bitwiseAND(F.lit(0xFFFF).cast("long"))
    return at(low) + F.shiftleft(at(low + 1), 32)


def simhash(pieces: DataFrame, keys: list[str], texts: dict[str, list[int]]) -> DataFrame:
    """``keys`` and a fingerprint for each name of ``texts``, which lists the pieces that a text is
    made of. ``pieces`` has one row per piece: ``keys``, ``which`` and ``piece``, cut at blanks.

    Words: A-Z lower-cased, cut at ASCII blanks; without words the fingerprint is 0. Where the rows
    of a key lie in one partition by one of the keys already, nothing is exchanged."""
    words = (pieces.select(*keys, "which", F.posexplode(F.split(ascii_lower(F.col("piece")), r"[\x20\x09-\x0D]+")).alias("pos", "word"))
             .select(*keys, "which", F.expr(f"pos DIV {WORDS}").alias("block"), F.xxhash64("word").alias("h"),
                     F.least(F.length("word"), F.lit(WEIGHT)).cast("long").alias("w")))
    four = lambda j: F.shiftright("h", 4 * j).bitwiseAND(F.lit(15).cast("long"))
    lanes = [F.sum((four(j) * F.lit(_SPREAD)).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"v{j}") for j in range(16)]
    blocks = words.groupBy(*keys, "which", "block").agg(F.sum("w").alias("weight"), *lanes)
    sums = []
    for name, parts in texts.items():
        own = lambda c, parts=parts: F.sum(F.when(F.col("which").isin(parts), c).otherwise(F.lit(0).cast("long")))
        sums.append(own(F.col("weight")).alias(f"{name}_weight"))
        sums += [own(_wide(F.col(f"v{j}"), low)).alias(f"{name}_{j}_{low}") for j in range(16) for low in (0, 2)]
    votes = blocks.groupBy(*keys).agg(*sums)

    def fingerprint(name: str) -> Column:
        out = F.lit(0).cast("long")
        for j in range(16):
            for s in range(4):
                ones = F.shiftright(f"{name}_{j}_{s // 2 * 2}", 32 * (s % 2)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
                out = out.bitwiseOR(F.when(ones * 2 > F.col(f"{name}_weight"), F.lit(_signed(1 << (4 * j + s)))).otherwise(
                    F.lit(0).cast("long")))
        return out.alias(name)

    return votes.select(*keys, *[fingerprint(name) for name in texts])


def in_order(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text``, ``n_chars``) with ``range``, ``nth`` and ``halo``: their
    place by doc_id, nulls last; rows of one doc_id stand in the order of the MD5 of their texts.

    Rows are dealt to ranges of doc_id with about ``range_chars`` characters and sorted there, so
    texts are exchanged once. A range ends with the first row of the next (the last range with
    that of the first), marked ``halo``, so that every row finds its successor in its own range."""
    docs = docs.withColumn("tie", F.md5("text"))
    total = docs.agg(F.sum("n_chars").alias("chars")).first()["chars"] or 0
    n = max(1, math.ceil(total / range_chars))
    at = [k / n for k in range(1, n)]
    cuts = docs.agg(F.percentile_approx("doc_id", at, max(10000, 20 * n)).alias("c")).first()["c"] if at else None
    cuts = sorted(set(cuts or []))                                # one number a range
    bounds = F.lit(cuts).cast("array<long>") if cuts else F.array().cast("array<long>")
    steps = F.sequence(F.lit(len(cuts).bit_length()), F.lit(0), F.lit(-1))

    def step(done: Column, j: Column) -> Column:
        # binary search for the number of bounds below the id
        to = done + F.call_function("shiftleft", F.lit(1), j)
        return F.when((to <= len(cuts)) & (F.get(bounds, to - 1) < F.col("doc_id")), to).otherwise(done)

    number = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.aggregate(steps, F.lit(0), step))
    placed = docs.withColumn("of", number)
    everything = Window.partitionBy(F.lit(0))                     # one row a range here
    ring = landed(placed.groupBy("of").agg(F.min(F.struct("doc_id", "tie")).alias("first")).select(
        "of", "first", F.coalesce(F.lag("of").over(Window.orderBy("of")), F.max("of").over(everything)).alias("before")),
        "ranges")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    own, copy = F.struct(F.col("of").alias("range"), F.lit(False).alias("halo")), F.struct(
        F.col("before").alias("range"), F.lit(True).alias("halo"))
    rows = placed.join(F.broadcast(ring), "of").select(
        "doc_id", "text", "n_chars", "tie", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))).alias("at"))
    order = Window.partitionBy("range").orderBy("halo", F.col("doc_id").asc_nulls_last(), "tie")
    return (rows.select("doc_id", "text", "n_chars", "tie", "at.range", "at.halo")
            .withColumn("nth", F.row_number().over(order)).withColumn("next", F.lead("text").over(order)).drop("tie"))


def edited_prints(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp`` for every row of ``docs``. Edited is
    a text whose last quarter of code points (rounded down) is replaced by as many first ones, or
    all, of the next document. The next of a repeated row may be its repetition (see ``in_order``).

    What text and edited text have in common up to the last blank before the cut is voted on once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = in_order(rows.withColumn("n_chars", F.length("text").cast("long")), range_chars)
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    head = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut)
    place = ["range", "nth", "halo", "doc_id", "n_chars"]
    parts = (rows.select(*place, "text", head.alias("head"),
                         F.concat(head, F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut)).alias("edited"))
             .withColumn("shared", F.regexp_extract("head", r"(?s)^(.*[\x20\x09-\x0D])?", 0))
             .withColumn("behind", F.length("shared") + 1))
    rest = lambda c: F.substring(F.col(c), F.col("behind"), F.length(c))
    pieces = parts.select(*place, F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(
        F.array("shared", rest("text"), rest("edited"))).alias("which", "piece"))
    prints = simhash(pieces, [*place, "edited_sha256"], {"fp": [0, 1], "edited_fp": [0, 2]})
    following = F.lead("fp").over(Window.partitionBy("range").orderBy("nth"))
    return (prints.withColumn("next_fp", following).filter(~F.col("halo"))
            .select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"))


def block_masks(blocks: int, radius: int) -> list[int]:
    """The bits of every choice of ``blocks - radius`` of the blocks."""
    edge = [BITS * k // blocks for k in range(blocks + 1)]
    each = [(1 << edge[k + 1]) - (1 << edge[k]) for k in range(blocks)]
    return [sum(some) for some in combinations(each, blocks - radius)]


def near_pairs(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None,
               slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Every pair of rows of ``distinct`` (``fp`` distinct, others; stored) with at most ``radius``
    differing bits, once: structs ``x`` and ``y`` of whole rows, ``x.fp`` the lesser, and ``distance``.

    More blocks make more tables with longer keys; by default the keys are long enough for a
    few fingerprints each, if bits are even. Fingerprints alone with their key leave a table at
    once. Those of a frequent key are dealt to slots, and meet the others of the key there."""
    if blocks is None:
        want = math.log2(max(distinct.count(), 2)) - 3
        blocks = next(b for b in range(radius + 1, BITS + 1) if BITS * (b - radius) // b >= want)
    masks = block_masks(blocks, radius)
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                                for k, m in enumerate(masks)]))
    placed = distinct.select(F.struct("*").alias("row"), table.alias("at")).select("row", "at.t", "at.key")
    crowded = (placed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
               .select("t", "key", F.ceil(F.col("n") / slot_rows).alias("slots")))
    able = join_small(placed, crowded, ["t", "key"])
    left = able.select("t", "key", F.pmod(F.xxhash64("row.fp"), F.col("slots")).alias("slot"), F.col("row").alias("x"))
    right = able.select("t", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"),
                        F.col("row").alias("y"))
    apart = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    # not in an earlier table too
    new = F.lit(True)
    for k, m in enumerate(masks):
        new = new & ((F.col("t") <= k) | (apart.bitwiseAND(F.lit(_signed(m))) != 0))
    return (left.join(right, ["t", "key", "slot"])
            .filter((F.col("x.fp") < F.col("y.fp")) & (F.bit_count(apart) <= radius) & new)
            .select("x", "y", F.bit_count(apart).alias("distance")))


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None,
                slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``fp, n_near, least_near`` for fingerprints of ``prints`` (``doc_id``, ``fp``) that have others
    within ``radius``: the number of these, and the least doc_id of all their documents. Documents
    of one fingerprint are folded first."""
    distinct = landed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints-distinct")
    pairs = near_pairs(distinct, radius, blocks, slot_rows)
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("x.fp").alias("fp"), F.col("x.least").alias("own"), F.col("y.least").alias("other")),
        F.struct(F.col("y.fp").alias("fp"), F.col("y.least").alias("own"), F.col("x.least").alias("other")))).alias("e"))
    return ends.select("e.*").groupBy("fp").agg(F.count("*").alias("n_near"),
                                                F.min(F.least("own", "other")).alias("least_near"))


def report(docs: DataFrame, radius: int = RADIUS, range_chars: int = RANGE_CHARS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, and ``n_near``, the number of other fingerprints of the table within
    ``radius`` bits, with ``least_near``, the least doc_id among the documents of these and its own.

    Null text counts as empty; texts without words have fingerprint 0, which is near to others like
    any. Whole texts are read, however long. Ids are ordered with nulls last, a null id is no
    ``least_near`` unless there is none else; see ``in_order`` for ties and repeated rows, which get
    a row each. An empty table gives an empty one. Other columns are not read."""
    prints = landed(edited_prints(docs, range_chars), "prints")
    near = landed(near_counts(prints.select("doc_id", "fp"), radius), "prints-near")
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("fp", "least")
    known = landed(near.join(own, "fp", "full").select(
        "fp", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce("least_near", "least").alias("least_near")), "prints-known")
    return (prints.join(known, "fp", "left")
            .select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"),
                    as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
                    likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                    likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.coalesce("least_near", "doc_id").alias("least_near")))
