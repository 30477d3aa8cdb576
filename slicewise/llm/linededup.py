"""Line deduplication: an edit-distance join by segments, all in DataFrame functions.

Two lines are linked if few edits (insert, delete, replace one character) turn one into the other:
one for every ``per_edit`` characters of the shorter line, at most ``k``, so that shorter lines than
``per_edit`` repeat only exactly. For the budget ``k`` of a length every line is cut into ``k + 1`` segments; a line within ``k`` edits holds one of them
unchanged, at a position that the lengths bound to a few places. So each line gives ``k + 1`` index
signatures for its own length, and probe signatures for the lengths ``len - k`` to ``len``.
Signatures are hashes of (segment, its number, the length). Pass one only counts which signatures
are shared by different lines, one aggregate with map-side combine over hashes; pass two joins the
few lines that hold such a signature, with the edit test inside the join, so no candidate pair
ever becomes a row. Sketches of 64 bits go first there: a segment common to many lines brings all
their pairs, and few of these need the distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import BROADCAST_ROWS, row_key, small
from slicewise.llm.components import components
from slicewise.sinks.tables import landed

#: Most edits between two lines of a class, and characters of the shorter line that allow one.
MAX_EDITS, PER_EDIT = 2, 12


def within_edits(a: Column, b: Column, k: int = MAX_EDITS) -> Column:
    """Whether at most ``k`` edits turn ``a`` into ``b`` (either may be the longer). The distance is
    the compiled one within a band of 2k + 1: common segments bring many pairs, and a fold of
    expressions over the characters of each would leave an object a step on the heap."""
    return (F.abs(F.length(a) - F.length(b)) <= k) & (F.levenshtein(a, b, k) >= 0)


def _places(k: int) -> list[tuple[int, int, int]]:
    """(segment, length less by, shift) of every signature of a line. For a segment ``i`` of a line
    shorter by ``delta``, edits before it move it by at most ``i`` and edits after it by at most
    ``k - i``, seen from the other end. (i, 0, 0) is the line's own segment."""
    return [(i, delta, off) for i in range(k + 1) for delta in range(k + 1)
            for off in range(max(-i, delta - (k - i)), min(i, delta + (k - i)) + 1)]


def _budget(n: Column, k: int, per_edit: int) -> Column:
    """Edits between two lines of which the shorter one has ``n`` characters."""
    return F.least(F.lit(k), F.floor(n / per_edit).cast("int"))


def _sketch(line: Column) -> Column:
    """64 parities of the line's pairs of neighbouring characters, dealt by a hash. An edit removes and
    adds at most two pairs each, so it changes four bits at most; other texts differ in about half."""
    def parities(wide: Column) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(
            F.xxhash64(F.substring(wide, i * 4 + 1, F.lit(8))), F.lit(64)).cast("int"))
        return F.aggregate(F.sequence(F.lit(0), F.floor(F.length(wide) / 4).cast("int") - 2), F.lit(0).cast("long"),
                           lambda acc, i: acc.bitwiseXOR(bit(i)))

    # the encoded line is an element of an array, else it would be made anew for every character
    return F.when(F.length(line) > 1, F.transform(F.array(F.encode(line, "UTF-32")), parities)[0]
                  ).otherwise(F.lit(0).cast("long"))


def _near(x: Column, y: Column, sketches: Column, k: int, per_edit: int) -> Column:
    """Whether ``x``, the shorter one or one of the same length, is within its budget of ``y``;
    ``sketches``: in how many bits their sketches differ."""
    out = F.when(F.lit(False), F.lit(False))
    for e in range(k, 0, -1):
        out = out.when(F.length(x) >= e * per_edit, (sketches <= 4 * e) & within_edits(x, y, e))
    return out.otherwise(F.lit(False))


def _signed(able: DataFrame, k: int, per_edit: int) -> DataFrame:
    """``line, sig, own`` for every signature of every line: the hash of a piece of the line with
    the number of the segment and the length it is looked for at.

    The places are rows first and one expression works on each: one small loop, where an array
    of a dozen long expressions would be code too large to be compiled."""
    def places(e: int) -> Column:
        return F.array(*[F.struct(F.lit(e).alias("e"), F.lit(i).alias("i"), F.lit(d).alias("d"), F.lit(o).alias("o"))
                         for i, d, o in _places(e)])

    # a line has the places of each budget that a line as long, or shorter by that budget, can have
    n = F.col("n")
    own = [F.when((n >= e * per_edit) & (F.lit(e == k) | (n < (e + 1) * per_edit + e)), places(e))
           .otherwise(F.slice(places(e), 1, 0)) for e in range(1, k + 1)]
    place = F.explode(F.concat(*own)).alias("at")
    # the last (length mod (e + 1)) of the e + 1 segments are one longer than the others
    # four bytes a character, so that a piece is found without counting through the line
    wide = able.select("line", "n", F.encode("line", "UTF-32").alias("wide"))
    cut = (wide.select("line", "n", "wide", place).select("line", "n", "wide", "at.e", "at.i", "at.d", "at.o")
           .withColumn("of", F.col("n") - F.col("d")).filter(F.col("e") == _budget(F.col("of"), k, per_edit))
           .withColumn("size", F.expr("CAST(of DIV (e + 1) AS INT)"))
           .withColumn("extra", F.greatest(F.col("i") - (F.col("e") + 1) + F.pmod("of", F.col("e") + 1), F.lit(-1)))
           .withColumn("start", F.col("i") * F.col("size") + F.greatest("extra", F.lit(0)) + 1 + F.col("o"))
           .withColumn("size", F.col("size") + (F.col("extra") >= 0).cast("int")))
    fits = cut.filter((F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= F.col("n")))
    sig = F.xxhash64(F.substring("wide", F.col("start") * 4 - 3, F.col("size") * 4), "i", "of")
    return fits.select("line", sig.alias("sig"), ((F.col("d") == 0) & (F.col("o") == 0)).cast("int").alias("own"))


def _lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    # the key is made before lines are cut, so that no text travels along with its lines
    parts = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text)).alias("key"),
                        F.split(F.col(text), "\n").alias("parts"))
    return parts.select("id", "key", F.posexplode("parts").alias("line_no", "line")).withColumn("line", F.rtrim("line", F.lit("\r"))).withColumn("n", F.length("line"))


def line_links(lines: DataFrame, k: int = MAX_EDITS, per_edit: int = PER_EDIT,
               broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``a, b``: digests of every two different texts of ``lines`` (columns ``line``, ``n``) that are
    at most ``k`` edits and at most one for every ``per_edit`` characters of the shorter one apart,
    each pair once."""
    able = lines.filter((F.col("n") >= per_edit) & (F.btrim("line") != "")).select("line", "n")
    signed = _signed(able, k, per_edit)
    shared = (signed.select("sig", "own", F.xxhash64("line").alias("id"))
              .groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("own").alias("own"))
              .filter((F.col("lo") != F.col("hi")) & (F.col("own") == 1)).select("sig"))
    shared = landed(shared, "lines-shared")
    n = shared.count()
    if n > broadcast_rows:
        # beyond the bound: first the lines that matter, by a join of hashes, so that texts of
        # other lines do not travel once per signature
        narrow = signed.select("sig", F.xxhash64("line").alias("id")).join(shared, "sig", "left_semi")
        ids = landed(narrow.select("id").distinct(), "lines-ids")
        able = able.withColumn("id", F.xxhash64("line")).join(ids, "id", "left_semi").drop("id")
        signed = _signed(landed(able.distinct(), "lines-able"), k, per_edit)
    # a segment common to many lines brings all their pairs: a number made once a line tells most apart
    held = landed(signed.join(small(shared, n, broadcast_rows), "sig", "left_semi").distinct()
                  .withColumn("sketch", _sketch(F.col("line"))), "lines-held")
    left = held.filter("own = 1").select("sig", F.col("line").alias("x"), F.col("sketch").alias("s"))
    right = held.select("sig", F.col("line").alias("y"), F.col("sketch").alias("t")).distinct()
    apart = F.bit_count(F.col("s").bitwiseXOR(F.col("t")))
    # of two lines of one length either may be the one that probes
    ordered = (F.length("x") < F.length("y")) | ((F.length("x") == F.length("y")) & (F.col("x") != F.col("y")))
    return (left.join(right, (left.sig == right.sig) & ordered & _near(F.col("x"), F.col("y"), apart, k, per_edit))
            .select(F.md5(F.least("x", "y")).alias("a"), F.md5(F.greatest("x", "y")).alias("b")).distinct())


def line_classes(docs: DataFrame, k: int = MAX_EDITS, per_edit: int = PER_EDIT,
                 id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line of every document: ``id, key, line_no`` (from 0), ``class_id``,
    ``n_links`` and ``kept``.

    class_id is the least digest among the lines connected to this one, n_links the number of
    other texts linked to this one (see ``line_links``), and ``kept`` marks the class's first line in
    the order of (id, key, line_no), null ids last. Lines of any length have a class, except those
    of spaces only, which separate paragraphs: they have none and are kept. Lines end at a line
    feed; a carriage return before it is no part of the line. Null texts have no lines, an empty
    table gives an empty one. Rows repeated as a whole have the same position and stay or go
    together; other columns are not read.
    """
    lines = _lines(docs, id_col, text)
    edges = landed(line_links(lines, k, per_edit), "line-links")
    roots = landed(components(edges), "line-roots")
    degree = edges.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(
        F.count("*").alias("n_links"))
    near = landed(roots.select(F.col("node").alias("digest"), "root").join(degree, "digest"), "line-near")
    near = small(near, near.count() * 4)
    own = landed(lines.select("id", "key", "line_no", F.when(F.btrim("line") != "", F.md5("line")).alias("digest"))
                 .join(near, "digest", "left")
                 .select("id", "key", "line_no", F.coalesce("root", "digest").alias("class_id"),
                         F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "line-own")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key", "line_no")
    first = (own.filter(F.col("class_id").isNotNull()).groupBy("class_id")
             .agg(F.min(place).alias("first"), F.count("*").alias("n"))
             .filter(F.col("n") > 1).select("class_id", "first"))
    first = landed(first, "line-first")        # stored, so that Spark can split a hot class
    return (own.join(first, "class_id", "left")
            .select("id", "key", "line_no", "class_id", "n_links",
                    (F.col("first").isNull() | (place == F.col("first"))
                     | (F.col("id").isNull() & (F.col("first.key") == F.col("key"))
                        & (F.col("first.line_no") == F.col("line_no")))).alias("kept")))


def report(docs: DataFrame) -> DataFrame:
    """``line_classes`` without keys; a class is named by the least digest of its lines."""
    return line_classes(docs).select(F.col("id").alias("doc_id"), "line_no", "class_id", "n_links", "kept")


def dedup_lines(docs: DataFrame, k: int = MAX_EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """``docs`` with every line gone that repeats an earlier one (see ``line_classes``), and
    without documents of which then only blanks remain. A column ``n_chars`` follows the text;
    documents that lose nothing stay as they are, null and empty texts too."""
    gone = (line_classes(docs, k, per_edit).filter(~F.col("kept"))
            .groupBy("key").agg(F.collect_set("line_no").alias("gone")))
    held = docs.select(F.struct("*").alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    parts = F.split("row.text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    text = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    cut = held.join(gone, "key", "left").withColumn("cut", F.when(F.col("gone").isNotNull(), text))
    row = F.col("row").withField("text", F.col("cut"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("cut").cast(docs.schema["n_chars"].dataType))
    return (cut.filter(F.col("cut").isNull() | (F.btrim(F.col("cut"), F.lit(" \n\r\t")) != ""))
            .select(F.when(F.col("gone").isNull(), F.col("row")).otherwise(row).alias("row")).select("row.*"))
