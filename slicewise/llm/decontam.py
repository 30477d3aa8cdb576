"""Benchmark decontamination: test n-grams as a broadcast set, scanned over training windows.

Words are maximal runs outside ``SEPARATOR`` after lower-casing A-Z. A window is ``n`` consecutive
words of a benchmark item; an item with fewer words is one window. Instead of every document
window only every block of ``block`` words at a multiple of ``block`` is probed: a run of ``n``
words always covers one whole block if ``block <= (n + 1) // 2``. Blocks that occur in the
benchmark propose the windows around them, and those are compared word by word with the
benchmark's windows, so the result is exact. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import BROADCAST_ROWS, ascii_lower, row_key, small
from slicewise.sinks.tables import landed

#: Fixed value. Characters that end a word.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing: A-Z are letters of words there.
RAW_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WINDOW = 10


def words_of(text: Column) -> Column:
    """Array of words; empty for null and for texts without words."""
    flat = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR, " ")
    return F.filter(F.split(F.btrim(flat), " "), lambda w: w != "")


def _block(size: Column) -> Column:
    """Length of the blocks that find every window of ``size`` words."""
    return F.floor((size + 1) / 2).cast("int")


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct windows: words joined by blanks, their number, and the items that hold them.

    Null texts give none; equal items are all named; a null item_id counts as an item without
    a name, shown as an empty string.
    """
    words = (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                              words_of(F.col("text")).alias("w"))
             .filter(F.size("w") > 0)
             .withColumn("m", F.least(F.size("w"), F.lit(n))))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1))
    return (words.select("item", "m", "w", starts.alias("s"))
            .select("item", "m", F.array_join(F.slice("w", F.col("s"), F.col("m")), " ").alias("window"))
            .groupBy("window", "m").agg(F.sort_array(F.collect_set("item")).alias("items")))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW,
         id_col: str = "doc_id", text: str = "text",
         broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per distinct (id, text): ``key``, id, ``n_words``, ``hit`` (sorted word positions
    from 0 inside any occurrence of a window) and ``items`` (sorted ids of items that occur).

    Rows with null text have no words. Repeated rows share one result row; an empty table on
    either side gives no hits. Documents of any length are read whole.
    """
    windows = landed(benchmark_windows(benchmark, n), "decontam-windows")
    sizes = [r["m"] for r in windows.select("m").distinct().orderBy("m").collect()]   # at most n
    grams = landed(windows.select(
        _block(F.col("m")).alias("b"), F.col("m"),
        F.explode(F.transform(
            F.sequence(F.lit(0), F.col("m") - _block(F.col("m"))),
            lambda i: F.xxhash64(F.slice(F.split("window", " "), i + 1, _block(F.col("m"))),
                                 F.col("m")))).alias("gram"))
        .select("gram").distinct(), "decontam-grams")
    grams = small(grams, grams.count(), broadcast_rows)
    windows = small(windows, windows.count() * 8, broadcast_rows)

    def probes(size: int) -> Column:
        """Blocks of one window length, each with the words a window over it can reach."""
        b = (size + 1) // 2
        at = F.sequence(F.lit(0), F.size("w") - b, F.lit(b))

        def one(i: Column) -> Column:
            first = F.greatest(i - (size - b), F.lit(0))
            return F.struct(
                F.xxhash64(F.slice("w", i + 1, F.lit(b)), F.lit(size)).alias("gram"),
                F.lit(size).alias("m"), first.alias("first"),
                F.array_join(F.slice("w", first + 1, i + size - first), " ").alias("around"))

        return F.when(F.size("w") >= size, F.transform(at, one)).otherwise(
            F.array().cast("array<struct<gram:bigint,m:int,first:int,around:string>>"))

    base = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text)).alias("key"),
                       words_of(F.col(text)).alias("w"))
    mark = F.struct(F.lit(None).cast("bigint").alias("gram"), F.lit(0).alias("m"),
                    F.lit(0).alias("first"), F.lit("").alias("around"))
    scanned = (base.select("id", "key", F.size("w").alias("n_words"),
                           F.explode(F.concat(F.array(mark), *[probes(m) for m in sizes])).alias("p"))
               .select("id", "key", "n_words", "p.*"))
    kept = (scanned.join(grams.select("gram", F.lit(True).alias("known")), "gram", "left")
            .filter(F.col("known") | (F.col("m") == 0)))
    near = F.split("around", " ")
    proposed = (kept.select("id", "key", "n_words", "m", "first", near.alias("near"))
                .select("id", "key", "n_words", "m", F.explode(F.when(
                    F.col("m") > 0, F.transform(
                        F.sequence(F.lit(0), F.size("near") - F.col("m")),
                        lambda i: F.struct((F.col("first") + i).alias("s"), F.array_join(
                            F.slice("near", i + 1, F.col("m")), " ").alias("window"))))
                    .otherwise(F.array(F.struct(F.lit(-1).alias("s"),
                                                F.lit("").alias("window"))))).alias("c"))
                .select("id", "key", "n_words", "m", "c.s", "c.window"))
    found = (proposed.join(windows, ["window", "m"], "left")
             .filter(F.col("items").isNotNull() | (F.col("s") == -1)))
    # positions are folded map-side into one row per (document, window start), which is the most
    # that copies of a document can add
    once = found.groupBy("id", "key", "n_words", "m", "s").agg(F.first("items").alias("items"))
    inside = F.when(F.col("s") >= 0, F.sequence("s", F.col("s") + F.col("m") - 1)).otherwise(
        F.array().cast("array<int>"))
    return (once.groupBy("key", "id", "n_words")
            .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(inside)))).alias("hit"),
                 F.sort_array(F.array_distinct(F.flatten(F.collect_list(
                     F.coalesce("items", F.array().cast("array<string>")))))).alias("items")))


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, benchmark, n).select("key", "n_words", "hit", "items")
    own = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    return own.join(found, "key").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` without rows whose text holds a window. All columns stay, whatever their names;
    rows with null or empty text stay."""
    bad = landed(hits(docs, benchmark, n).filter(F.size("hit") > 0).select("key"), "decontam-bad")
    bad = small(bad, bad.count() * 4)          # within the bound no text has to move
    held = docs.select(F.struct("*").alias("row"),
                       row_key(F.col("doc_id"), F.col("text")).alias("key"))
    return held.join(bad, "key", "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words, and the separators after them, cut out of their texts. Other
    words and separators stay as they are; null texts stay null."""
    found = landed(hits(docs, benchmark, n).filter(F.size("hit") > 0).select("key", "hit"), "decontam-hits")
    held = docs.select(F.struct("*").alias("row"),
                       row_key(F.col("doc_id"), F.col("text")).alias("key"))
    between, letter = RAW_SEPARATOR, f"[^{RAW_SEPARATOR[1:-1]}]"
    pieces = F.regexp_extract_all("row.text", F.lit(f"{letter}++{between}*+"), F.lit(0))
    head = F.regexp_extract("row.text", f"^{between}*+", 0)
    left = F.array_except(F.sequence(F.lit(1), F.size(pieces)), F.transform("hit", lambda i: i + 1))
    cut = F.concat(head, F.array_join(F.transform(left, lambda i: F.get(pieces, i - 1)), ""))
    text = F.when(F.col("hit").isNull(), F.col("row.text")).otherwise(cut)
    return (held.join(found, "key", "left")
            .select(F.col("row").withField("text", text).alias("row")).select("row.*"))
