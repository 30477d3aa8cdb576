"""Quality by an n-gram language model: interpolated modified Kneser-Ney over words, of order two.

Counts come from every trusted document, without a vocabulary or count limit. For a pair (u, w)

    log P(w | u) = log beta(w) + log gamma(u) + [seen] * delta(u, w),

with beta the lower-order probability and gamma the weight that u leaves to it, because a pair that
was never seen has no mass of its own. So a document's score is one join of its words and pairs
with one table of (hash, value), summed: no document, vocabulary or model is ever held in one
place. A document is kept if its log-perplexity is at most its language's quantile.

Words and pairs outweigh the text they come from, so the job is done in slices: a slice holds the
words, and the pairs by their first word, of an equal share of all hashes. Each slice reads the
text again, and its shuffles are dropped before the next; only sums by word and by document stay. Pairs
travel in blocks of arrays, cut by ranges of their hash, and are counted range by range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewise.llm.common import BROADCAST_ROWS, small
from slicewise.sinks.tables import batches_within, landed, shuffles_dropped

#: Production parameters: quantile of log-perplexity up to which documents stay, width of the
#: bins in which quantiles are counted.
QUANTILE, BIN = 0.95, 0.001
START, END = "\u0001", "\u0002"
#: Slices in which pairs are counted and documents scored: the more, the less disk, the more reading.
#: Fewer where a slice would have under SLICE_ROWS words and pairs.
COUNT_SLICES, SCORE_SLICES, SLICE_ROWS = 2, 8, 4_000_000
#: Shards of a slice, and the words and pairs of documents at which there are more. A document has
#: a sum in each shard that it meets, so shards are no more than memory asks for: their documents
#: stream, and only the model's values are held.
SHARDS, SHARD_ROWS = 16, 8_000_000
#: Bytes of text that a worker hashes at once, so that they stay in its cache, and documents whose
#: words and pairs it sends together.
PORTION_BYTES, BLOCK_DOCS = 1 << 20, 4096
#: Bytes of a batch sent to a worker, pairs that it counts at once before they travel, and rows that
#: it hands back at once.
BATCH_BYTES, BLOCK_PAIRS, OUT_ROWS = 8 << 20, 1 << 20, 50_000
_MIX, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(7)
_FOLD = np.arange(256, dtype=np.uint8)          # A-Z lower-cased, ASCII blanks alike
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
BLOCK = ["shard", "docs", "owner", "grams", "n"]
BLOCK_SCHEMA = "shard int, docs binary, owner binary, grams binary, n binary"


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one buffer, start and end of each word in it, and the number of words of each
    text. A word is cut at ASCII blanks."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = _FOLD[np.frombuffer(b" ".join(texts), np.uint8)]
    buf = np.full(len(whole) + 9, 32, np.uint8)
    buf[1:len(whole) + 1] = whole
    blank = buf == 32
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    at, end = edge[::2], edge[1::2]
    return buf, at, end, np.diff(np.searchsorted(at, np.cumsum(sizes + 1) + 1), prepend=0)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, eight bytes of all words at a time, and the
    number of words of each text."""
    buf, at, end, n = _cut(texts)
    size = end - at
    eight = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
    h = _stir((size.astype(np.uint64) + _SEED) * _MIX)
    h = _stir(h ^ (eight[at] & _MASK[np.minimum(size, 8)]))
    more, done = np.flatnonzero(size > 8), 8
    while len(more):
        h[more] = _stir(h[more] ^ (eight[at[more] + done] & _MASK[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    return h, n


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (u ^ (u >> np.uint64(31))) * _MIX + w
    return (h ^ (h >> np.uint64(29))) * _MIX


_START, _END = (word_hashes([x.encode()])[0][0] for x in (START, END))


def _pairs(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second words of all pairs; a text of n words, its marks included, has n + 1."""
    first = np.cumsum(n + 2) - (n + 2)
    chain = np.empty(len(h) + 2 * len(n), np.uint64)
    chain[np.arange(len(h)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = h
    chain[first], chain[first + n + 1] = _START, _END
    return np.delete(chain, first + n + 1), np.delete(chain, first)


def _portions(texts: pd.Series) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in runs of bounded size, each with the place of its first; null is empty."""
    run, size = [], 0
    for i, text in enumerate(texts):
        if run and size + len(text or b"") > PORTION_BYTES:
            yield i - len(run), run
            run, size = [], 0
        run.append(text or b"")
        size += len(run[-1])
    if run:
        yield len(texts) - len(run), run


def _in_slice(h: np.ndarray, k: int, of: int) -> np.ndarray:
    return np.flatnonzero((h & np.uint64(0xFFFF)) * np.uint64(of) >> np.uint64(16) == np.uint64(k))


def _slice_is(h: Column, k: int, of: int) -> Column:
    return F.shiftright(h.bitwiseAND(F.lit(0xFFFF)) * of, 16) == k


def _starts(x: np.ndarray) -> np.ndarray:
    """Places at which a value of ``x`` begins that differs from the one before."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[:len(x)])


def _cuts(g: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """Shard, begin and end of its part of the sorted hashes ``g``."""
    shard = (g >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)
    edge = np.append(_starts(shard), len(g))
    return ((int(shard[i]), i, j) for i, j in zip(edge[:-1], edge[1:]))


def _pair_blocks(docs: DataFrame, k: int, of: int, shards: int) -> DataFrame:
    """The word pairs of slice ``k`` with their counts, summed over BLOCK_PAIRS or more before they
    travel: then a row per shard, as arrays in order of the pairs' hashes."""
    def summed(found: list[np.ndarray]) -> pd.DataFrame:
        u, w = np.concatenate(found, 1)
        g = pair_hash(u, w)
        order = np.argsort(g)
        g = g[order]
        new = _starts(g)
        u, w, c = u[order[new]], w[order[new]], np.diff(new, append=len(g)).astype(np.int32)
        return pd.DataFrame([(x, u[i:j].tobytes(), w[i:j].tobytes(), c[i:j].tobytes())
                             for x, i, j in _cuts(g[new], shards)], columns=["shard", "u", "w", "c"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, size = [], 0
        for b in batches:
            for _, texts in _portions(b["raw"]):
                u, w = _pairs(*word_hashes(texts))
                mine = _in_slice(u, k, of)
                found.append(np.stack([u[mine], w[mine]]))
                size += len(mine)
                if size >= BLOCK_PAIRS:
                    yield summed(found)
                    found, size = [], 0
        if size:
            yield summed(found)

    rows = docs.select(F.col("text").cast("binary").alias("raw"))
    return rows.mapInPandas(run, "shard int, u binary, w binary, c binary")


def _counted(docs: DataFrame, k: int, of: int, shards: int, sums: Callable[..., dict], schema: str) -> DataFrame:
    """Rows of ``sums(u, w, c)``, called with the distinct pairs of each shard of slice ``k`` and
    their counts over ``docs``."""
    def merged(blocks: list[tuple[bytes, bytes, bytes]]) -> Iterator[pd.DataFrame]:
        u, w, c = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*blocks), (np.uint64, np.uint64, np.int32)))
        g = pair_hash(u, w)
        order = np.argsort(g)
        new = _starts(g[order])
        out = pd.DataFrame(sums(u[order[new]], w[order[new]], np.add.reduceat(c[order].astype(np.int64), new)))
        for i in range(0, len(out), OUT_ROWS):
            yield out.iloc[i:i + OUT_ROWS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, blocks = None, []
        for b in batches:
            for x, *block in zip(b["shard"], b["u"], b["w"], b["c"]):
                if x != shard and blocks:
                    yield from merged(blocks)
                    blocks = []
                shard = x
                blocks.append(block)
        if blocks:
            yield from merged(blocks)

    return (_pair_blocks(docs, k, of, shards).repartition(shards, "shard").sortWithinPartitions("shard")
            .mapInPandas(run, schema))


def pair_counts(docs: DataFrame, k: int = 0, of: int = 1, shards: int = SHARDS) -> DataFrame:
    """``u, w, c``: counts over ``docs`` of the word pairs of slice ``k``."""
    return _counted(docs, k, of, shards, lambda u, w, c: {"u": u.view(np.int64), "w": w.view(np.int64), "c": c},
                    "u long, w long, c long")


def _discounts(n: list[float]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times, each within [0, count]."""
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    out = [k - (k + 1) * y * (n[k] / n[k - 1] if n[k - 1] else 0.0) for k in (1, 2, 3)]
    return [min(max(d, 0.05), k) for k, d in enumerate(out, 1)]


def _pick(count: Column, d: list[float]) -> Column:
    return F.when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])


class Model:
    """``words``: table ``h, total, left, n`` with one row per known word: how often it is followed,
    the discounts it leaves and the number of kinds of words before it; ``d`` and ``beta`` complete
    the probabilities; ``unknown``: log probability of a word that was never seen; ``frame``: what
    every document's marks add."""

    def __init__(self, trusted: DataFrame, words: DataFrame, d: list[float], beta: Column, unknown: float):
        self.trusted, self.words, self.d, self.beta, self.unknown = trusted, words, d, beta, unknown
        of = words.select("h", F.coalesce(F.log(F.col("left") / F.col("total")), F.lit(0.0)).alias("lg"),
                          F.when(F.col("n") > 0, F.log(beta)).otherwise(unknown).alias("lb"))
        marks = [int(x.view(np.int64)) for x in (_START, _END)]
        edge = {r["h"]: r for r in of.filter(F.col("h").isin(marks)).collect()}
        self.frame = edge[marks[0]]["lg"] + edge[marks[1]]["lb"]
        self._single = of.filter(~F.col("h").isin(marks)).select(
            F.col("h").alias("g"), (F.col("lg") + F.col("lb") - unknown).alias("v"))

    def values(self, k: int = 0, of: int = 1, shards: int = 1) -> DataFrame:
        """The value of each known word and each seen pair of the slice, in blocks as those of
        ``_doc_grams``: ``n`` has the values, ``docs`` is null."""
        lead = self.words.filter(_slice_is(F.col("h"), k, of) & (F.col("total") > 0)).select(F.col("h").alias("u"), "left")
        tail = self.words.filter("n > 0").select(F.col("h").alias("w"), self.beta.alias("beta"))
        own = (F.col("c") - _pick(F.col("c"), self.d)) / (F.col("left") * F.col("beta"))
        seen = pair_counts(self.trusted, k, of, shards).join(lead, "u").join(tail, "w").select(
            "u", "w", F.log1p(own).alias("v"), F.lit(True).alias("pair"))
        lone = self._single.filter(_slice_is(F.col("g"), k, of)).select(
            F.col("g").alias("u"), F.lit(0).cast("long").alias("w"), "v", F.lit(False).alias("pair"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                u, w = (b[c].to_numpy(np.int64).view(np.uint64) for c in ("u", "w"))
                g = np.where(b["pair"].to_numpy(bool), pair_hash(u, w), u)
                order = np.argsort(g)
                g, v = g[order], b["v"].to_numpy(float)[order]
                yield pd.DataFrame([(x, None, None, g[i:j].tobytes(), v[i:j].tobytes()) for x, i, j in _cuts(g, shards)],
                                   columns=BLOCK)

        return lone.union(seen).mapInPandas(run, BLOCK_SCHEMA)


_SUMS = ["total", "n1", "n2", "n3", "n4", "kinds", "n"]


def _word_sums(u: np.ndarray, w: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
    """``h`` and the sums of each word over some pairs."""
    order = np.argsort(u)
    led, c = u[order], c[order]
    new = _starts(led)
    kinds = np.diff(new, append=len(led))
    tail, n = np.unique(w, return_counts=True)
    ahead = [np.add.reduceat(x, new) for x in (c, *((c == i).astype(np.int64) for i in (1, 2, 3, 4)))] + [kinds]
    none = np.zeros(len(tail), np.int64)
    return {"h": np.concatenate([led[new], tail]).view(np.int64),
            **{name: np.concatenate([x, none]) for name, x in zip(_SUMS, ahead)},
            "n": np.concatenate([np.zeros(len(new), np.int64), n])}


def _word_counts(trusted: DataFrame, slices: int, shards: int) -> DataFrame:
    """``h, total, n1 .. n4, kinds, n`` of each word: how often it is followed, by how many kinds of
    words once to four times and at all, and the number of kinds before it."""
    add = lambda rows: rows.groupBy("h").agg(*(F.sum(c).alias(c) for c in _SUMS))
    schema = ", ".join(f"{c} long" for c in ["h", *_SUMS])
    parts = [landed(add(_counted(trusted, k, slices, shards, _word_sums, schema)), "lm-part") for k in range(slices)]
    return landed(add(reduce(DataFrame.union, parts)), "lm-words")


def train(trusted: DataFrame, slices: int = 1, shards: int = SHARDS) -> Model | None:
    """The model of all rows of ``trusted`` (column ``text``; null and empty texts count as
    documents without words). None if there is no row."""
    words = _word_counts(trusted, slices, shards)
    spread = words.agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in (1, 2, 3, 4))).first()
    if spread["n1"] is None:
        return None
    d = _discounts([spread[f"n{i}"] for i in (1, 2, 3, 4)])
    low = {r["k"]: r for r in words.filter("n > 0").groupBy(F.least("n", F.lit(5)).alias("k")).agg(
        F.count("*").alias("words"), F.sum("n").alias("pairs")).collect()}
    d1 = _discounts([low[k]["words"] if k in low else 0 for k in (1, 2, 3, 4)])
    kinds, total = sum(r["words"] for r in low.values()), float(sum(r["pairs"] for r in low.values()))
    spare = sum(d1[min(k, 3) - 1] * r["words"] for k, r in low.items()) / total
    floor = spare / (kinds + 1)                      # one more kind: all words never seen
    beta = (F.col("n") - _pick(F.col("n"), d1)) / total + floor
    left = F.col("n1") * d[0] + F.col("n2") * d[1] + (F.col("kinds") - F.col("n1") - F.col("n2")) * d[2]
    words = words.select("h", "total", F.when(F.col("total") > 0, left).alias("left"), "n")
    return Model(trusted, words, d, beta, float(np.log(floor)))


def _doc_grams(docs: DataFrame, k: int, of: int, shards: int) -> DataFrame:
    """Distinct words and pairs of each document in the slice, with their counts: one row per block
    of documents and shard, as arrays sorted by hash."""
    def grams(texts: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray]:
        h, n = word_hashes(texts)
        u, w = _pairs(h, n)
        lone, pair = _in_slice(h, k, of), _in_slice(u, k, of)
        place = np.arange(first, first + len(n))
        return (np.concatenate([h[lone], pair_hash(u[pair], w[pair])]),
                np.concatenate([np.repeat(place, n)[lone], np.repeat(place, n + 1)[pair]]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in range(0, len(b), BLOCK_DOCS):
                names, texts = b["doc"].to_numpy(np.int64)[x:x + BLOCK_DOCS], b["raw"].iloc[x:x + BLOCK_DOCS]
                g, doc = (np.concatenate(c) for c in zip(*(grams(t, first) for first, t in _portions(texts))))
                order = np.argsort(g, kind="stable")
                g, doc = g[order], doc[order]
                new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]))[:len(g)])
                count = np.diff(new, append=len(g)).astype(np.int32)
                g, doc = g[new], doc[new]
                out = []
                for where, i, j in _cuts(g, shards):
                    seen = np.zeros(len(names), bool)
                    seen[doc[i:j]] = True
                    owner = (np.cumsum(seen) - 1).astype(np.uint16)[doc[i:j]]
                    out.append((where, names[seen].tobytes(), owner.tobytes(), g[i:j].tobytes(), count[i:j].tobytes()))
                yield pd.DataFrame(out, columns=BLOCK)

    rows = docs.select(_doc(), F.col("text").cast("binary").alias("raw"))
    return rows.mapInPandas(run, BLOCK_SCHEMA)


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``doc, v``: sums over the shards of a partition. Of each shard the model's values come first
    and are held; its documents stream past them."""
    shard, g, v, ready = None, [], [], False
    for b in batches:
        docs, sums = [], []
        for at, names, owner, grams, n in zip(*(b[c] for c in BLOCK)):
            if at != shard:
                shard, g, v, ready = at, [], [], False
            if names is None:
                g.append(np.frombuffer(grams, np.uint64))
                v.append(np.frombuffer(n, float))
                continue
            if not ready:
                keys = np.concatenate([*g, np.zeros(0, np.uint64)])
                order = np.argsort(keys)
                keys, vals, ready = keys[order], np.concatenate([*v, np.zeros(0)])[order], True
                g, v = [], []
            if not len(keys):
                continue
            own, names = np.frombuffer(grams, np.uint64), np.frombuffer(names, np.int64)
            spot = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = np.flatnonzero(keys[spot] == own)
            add = np.bincount(np.frombuffer(owner, np.uint16)[hit],
                              np.frombuffer(n, np.int32)[hit] * vals[spot[hit]], len(names))
            some = np.flatnonzero(add)
            docs.append(names[some])
            sums.append(add[some])
        if docs:
            yield pd.DataFrame({"doc": np.concatenate(docs), "v": np.concatenate(sums)})


def _heads(docs: DataFrame) -> DataFrame:
    """``doc, n_words, copies`` per distinct (doc_id, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, texts in _portions(b["raw"]):
                n = _cut(texts)[3]
                yield pd.DataFrame({"doc": b["doc"].to_numpy(np.int64)[first:first + len(n)], "n_words": n.astype(np.int32)})

    rows = docs.select(_doc(), F.col("text").cast("binary").alias("raw")).mapInPandas(run, "doc long, n_words int")
    return landed(rows.groupBy("doc").agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies")), "lm-heads")


def perplexities(docs: DataFrame, heads: DataFrame, model: Model, slices: int = 1, shards: int = 1) -> DataFrame:
    """``doc, n_words, log_ppl`` per distinct (doc_id, text), named by a 64-bit hash; ``heads`` are
    those of ``docs``."""
    parts = []
    for k in range(slices):
        met = (model.values(k, slices, shards).union(_doc_grams(docs, k, slices, shards)).repartition(shards, "shard").sortWithinPartitions("shard", F.col("docs").isNotNull())
               .mapInPandas(_meet, "doc long, v double"))
        parts.append(landed(met.groupBy("doc").agg(F.sum("v").alias("v")), "lm-sums"))
    sums = reduce(DataFrame.union, parts).groupBy("doc").agg(F.sum("v").alias("v"))
    score = F.coalesce("v", F.lit(0.0)) / F.col("copies") + F.col("n_words") * model.unknown + model.frame
    return heads.join(sums, "doc", "left").select("doc", "n_words", (-score / (F.col("n_words") + 1)).alias("log_ppl"))


def _doc() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text").alias("doc")


def thresholds(scored: DataFrame, quantile: float = QUANTILE, width: float = BIN) -> DataFrame:
    """``lang, threshold``: the lower edge of the first bin at which at least ``quantile`` of the
    language's rows are at or below. Rows are counted per bin first, so a language with a third
    of all rows brings no more rows to its task than there are bins."""
    bins = (scored.groupBy("lang", F.round(F.col("log_ppl") / width).cast("long").alias("bin"))
            .agg(F.count("*").alias("n")))
    run = Window.partitionBy("lang").orderBy("bin")
    return (bins.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
            .filter(F.col("upto") >= F.col("all") * quantile).groupBy("lang").agg(F.min("bin").alias("bin"))
            .select("lang", ((F.col("bin") + 0.5) * width).alias("threshold")))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_words, log_ppl, threshold, keep.

    Trusted are the documents labelled quality 1 and not toxic. They are in the model and read
    easier than others, so the quantiles are those of the documents outside (of all, if a
    language has none outside). Null text has no words and is scored by its marks alone; a null
    lang is a language of its own; repeated rows share a score; without any trusted document
    there is no model: log_ppl and threshold are null and everything is kept.
    """
    good = (labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
            .select(F.col("doc_id").alias("id")).distinct())
    with shuffles_dropped(docs.sparkSession), batches_within(docs.sparkSession, BATCH_BYTES):
        return _judge(docs, good, quantile)


def _judge(docs: DataFrame, good: DataFrame, quantile: float) -> DataFrame:
    good = landed(good, "lm-trusted")
    count = good.count()
    near = small(good, count)
    base = docs.select("doc_id", "text", F.coalesce("lang", F.lit("(none)")).alias("lang"))
    trusted = base.join(near, F.col("doc_id") == F.col("id"), "left_semi").select("text")
    if count > BROADCAST_ROWS:          # every slice would shuffle the text
        trusted = landed(trusted, "lm-texts")
    heads = _heads(base)
    grams = heads.agg(F.sum((2 * F.col("n_words") + 1) * F.col("copies"))).first()[0] or 0
    count_slices, slices = (min(most, 1 + grams // SLICE_ROWS) for most in (COUNT_SLICES, SCORE_SLICES))
    shards = max(SHARDS, 1 + grams // (slices * SHARD_ROWS))
    model = train(trusted, count_slices, max(SHARDS, slices * shards // count_slices))
    out = docs.select("doc_id", F.col("lang"), F.coalesce("lang", F.lit("(none)")).alias("_lang"), _doc())
    if model is None:
        return out.select("doc_id", "lang", F.lit(None).cast("int").alias("n_words"), F.lit(None).cast("double").alias(
            "log_ppl"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
    scores = landed(perplexities(base, heads, model, slices, shards), "lm-scores")
    inside = near.select("id", F.lit(True).alias("inside"))
    known = landed(out.join(scores, "doc").join(inside, F.col("doc_id") == F.col("id"), "left")
                   .select("doc_id", "lang", F.col("_lang").alias("own"), "n_words",
                           F.round("log_ppl", 6).alias("log_ppl"), "inside"), "lm-known")
    of = lambda rows, name: thresholds(rows.select(F.col("own").alias("lang"), "log_ppl"), quantile).select(
        F.col("lang").alias("own"), F.col("threshold").alias(name))
    limit = of(known, "of_all").join(of(known.filter("inside IS NULL"), "outside"), "own", "left").select(
        "own", F.coalesce("outside", "of_all").alias("threshold"))
    return known.join(limit, "own").select("doc_id", "lang", "n_words", "log_ppl", F.round("threshold", 6).alias("threshold"),
                                           (F.col("log_ppl") <= F.col("threshold")).alias("keep"))
