"""SimHash near-duplicates by a self-join of binary tries.

Every document gets a 64-bit fingerprint. Equal fingerprints are folded first. The distinct ones
are dealt to buckets by their most even bits, which are the top levels of one binary trie; a
bucket meets only the buckets whose top bits differ in at most ``bits`` places. Each pair of
buckets is joined by walking the two subtries together from the root, adding up differing bits and
dropping a pair of nodes as soon as the sum exceeds the budget. A task reports a spanning forest of
its links, never all pairs of a dense group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import row_key
from slicewise.llm.components import components
from slicewise.sinks.tables import landed

SHINGLE, BITS, SEED = 3, 3, 42
#: Distinct fingerprints in a bucket (about); a fuller bucket is split into chunks of this size.
#: A fingerprint goes to every bucket within reach, and that number grows with the levels above
#: the buckets, so buckets are as large as a task can well hold. At least ``TOP`` levels, so that
#: small inputs too are spread over tasks.
BUCKET, TOP = 32768, 3
#: Pairs of trie nodes, and of leaves, that are held at a time.
FRONTIER, LEAVES = 1 << 20, 1 << 21


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; 0 if it has no words."""
    words = raw.lower().split() if raw else []        # bytes: only A-Z, only ASCII blanks
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        size = min(1 << 16, n - lo)
        runs = zip(*(words[lo + k:lo + k + size] for k in range(shingle)))
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64, size)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, key, fp`` for every row; ``key`` names the row's (doc_id, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b["raw"]), np.int64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "key": b["key"], "fp": fp})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       row_key(F.col("doc_id"), F.col("text")).alias("key"),
                       F.col("text").cast("binary").alias("raw"))
    return rows.mapInPandas(run, "doc_id long, key string, fp long")


class _Trie:
    """Nodes of each depth over sorted distinct keys: a node is a run of keys."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, {}

    def level(self, depth: int):
        """Start and length of each node, and its children for bit 0 and bit 1 (-1: none)."""
        if depth not in self.levels:
            start, bit = self._nodes(depth)
            size = np.diff(np.append(start, len(self.keys)))
            if depth == 64:
                self.levels[depth] = (start, size, None)
            else:
                below, bit = self._nodes(depth + 1)
                first = np.searchsorted(below, start)
                child = np.full((2, len(start)), -1, np.int64)
                child[bit[first], np.arange(len(start))] = first
                two = np.flatnonzero(np.diff(np.append(first, len(below))) == 2)
                child[1, two] = first[two] + 1
                self.levels[depth] = (start, size, child)
        return self.levels[depth]

    def _nodes(self, depth: int):
        if depth == 0:
            return np.zeros(1, np.int64), np.zeros(1, np.int64)
        head = self.keys >> np.uint64(64 - depth)
        start = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
        return start, (head[start] & np.uint64(1)).astype(np.int64)


def trie_pairs(a: np.ndarray, b: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of keys that differ in at most ``bits`` bits, in batches. Keys are
    sorted distinct uint64; ``b`` None: pairs within ``a``, each once."""
    if len(a) == 0 or (b is not None and len(b) == 0):
        return
    own = b is None
    ta = _Trie(a)
    tb = ta if own else _Trie(b)
    root = np.zeros(1, np.int64)
    stack = [(0, root, root, np.zeros(1, np.int8))]
    while stack:
        depth, i, j, diff = stack.pop()
        if len(i) > FRONTIER:
            half = len(i) // 2
            stack += [(depth, i[half:], j[half:], diff[half:]), (depth, i[:half], j[:half], diff[:half])]
            continue
        (sa, na, ca), (sb, nb, cb) = ta.level(depth), tb.level(depth)
        leaf = (na[i] * nb[j] <= 16) if depth < 64 else np.ones(len(i), bool)
        yield from _compare(a, ta.keys if own else b, sa[i[leaf]], na[i[leaf]], sb[j[leaf]], nb[j[leaf]],
                            bits, own)
        i, j, diff = i[~leaf], j[~leaf], diff[~leaf]
        if not len(i):
            continue
        parts = []
        for x in (0, 1):
            for y in (0, 1):
                p, q, d = ca[x][i], cb[y][j], diff + (x != y)
                keep = (p >= 0) & (q >= 0) & (d <= bits)
                if own and x == 1 and y == 0:
                    keep &= i != j
                parts.append((p[keep], q[keep], d[keep]))
        nxt = [np.concatenate(c) for c in zip(*parts)]
        if len(nxt[0]):
            stack.append((depth + 1, *nxt))


def _compare(a, b, sa, na, sb, nb, bits, own):
    if not len(sa):
        return
    total = na * nb
    ends = np.cumsum(total)
    lo = 0
    while lo < len(total):
        done = ends[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(ends, done + LEAVES, "right")), lo + 1)
        k = np.repeat(np.arange(lo, hi), total[lo:hi])
        at = np.arange(len(k)) - np.repeat(ends[lo:hi] - total[lo:hi] - done, total[lo:hi])
        u, v = sa[k] + at // nb[k], sb[k] + at % nb[k]
        near = np.bitwise_count(a[u] ^ b[v]) <= bits
        if own:
            near &= u < v
        if near.any():
            yield u[near], v[near]
        lo = hi


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least member of each one's component."""
    up = np.arange(n)
    for u, v in pairs:
        while True:
            ru, rv = up[u], up[v]
            apart = ru != rv
            if not apart.any():
                break
            u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
            np.minimum.at(up, np.maximum(ru, rv), np.minimum(ru, rv))
            while True:
                nxt = up[up]
                if (nxt == up).all():
                    break
                up = nxt
    return up


def _ordered_bits(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """Fingerprints with their bits put in ``order``, the first as the highest."""
    x, out = fp.view(np.uint64), np.zeros(len(fp), np.uint64)
    for k, bit in enumerate(order):
        out |= ((x >> np.uint64(bit)) & np.uint64(1)) << np.uint64(63 - k)
    return out


def _join_units(order: list[int], bits: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.int64)
        first = rows["unit"].to_numpy() == key[0]
        if key[0] == key[1]:
            sides = [fp]
        else:
            sides = [fp[first], fp[~first]]
        keys = [_ordered_bits(s, order) for s in sides]
        ranks = [np.argsort(k) for k in keys]
        keys = [k[r] for k, r in zip(keys, ranks)]
        flat = np.concatenate([s[r] for s, r in zip(sides, ranks)]) if len(fp) else fp
        shift = len(sides[0]) if len(sides) == 2 else 0
        pairs = ((u, v + shift) for u, v in trie_pairs(keys[0], keys[1] if shift or len(sides) == 2
                                                       else None, bits))
        up = forest(len(flat), pairs)
        moved = np.flatnonzero(up != np.arange(len(flat)))
        return pd.DataFrame({"a": flat[moved], "b": flat[up[moved]]})
    return run


def links(distinct: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` that connect exactly the fingerprints (column ``fp``, distinct and stored)
    connected by steps of at most ``bits`` differing bits."""
    ones = distinct.agg(F.count("*").alias("n"), *[
        F.sum(F.shiftright("fp", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(64)]).first()
    n = ones["n"]
    order = sorted(range(64), key=lambda k: (abs((ones[f"b{k}"] or 0) * 2 - n), k))
    depth = min(18, max(TOP, math.ceil(math.log2(max(n, 1) / bucket))))
    top = F.lit(0).cast("long")
    for k in range(depth):
        top = top.bitwiseOR(F.shiftleft(F.shiftright("fp", order[k]).bitwiseAND(F.lit(1)), depth - 1 - k))
    placed = distinct.select("fp", top.alias("p"))
    # at most 2**depth rows of two numbers, and depth <= 18
    chunks = landed(placed.groupBy("p").agg(F.ceil(F.count("*") / bucket).alias("c")), "simhash-buckets")
    masks = [sum(1 << k for k in some) for r in range(min(bits, depth) + 1)
             for some in combinations(range(depth), r)]
    unit = lambda p, c: p * F.lit(1 << 24) + c
    mine = F.pmod(F.xxhash64("fp"), F.col("c")).cast("long")
    met = (placed.join(F.broadcast(chunks), "p")
           .select("fp", "p", unit(F.col("p"), mine).alias("unit"),
                   F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
           .select("fp", "unit", F.col("p").bitwiseXOR(F.col("mask")).alias("q"))
           .join(F.broadcast(chunks.select(F.col("p").alias("q"), F.col("c").alias("cq"))), "q")
           .select("fp", "unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cq") - 1)).alias("other"), "q")
           .select("fp", "unit", unit(F.col("q"), F.col("other")).alias("with")))
    return (met.groupBy(F.least("unit", "with").alias("u"), F.greatest("unit", "with").alias("v"))
            .applyInPandas(_join_units(order, bits), "a long, b long"))


def classes(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, key, fp, component_id, root`` for every row of ``docs``; ``root`` is a fingerprint
    that names the component.

    component_id is the smallest doc_id reachable over links, the own included. Rows with null or
    wordless text have fingerprint 0 and are linked like any others; null doc_ids count for
    nothing in the minimum, so a component of null ids alone has a null id; repeated rows are
    members like others; an empty table gives an empty one. Only fingerprints travel: the text
    is read where it lies, whole, and other columns are not read.
    """
    prints = landed(fingerprints(docs, shingle), "simhash-prints")
    distinct = landed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, bits))
    rooted = landed(distinct.join(roots, distinct.fp == roots.node, "left")
                    .select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "component_id", "root"), "fp")


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                "component_id")


def keep_one(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (null last;
    among rows repeated with one doc_id, the one whose key is least; among equal rows any).
    Texts that differ under one doc_id and are not linked are components of their own."""
    found = landed(classes(docs, bits, shingle), "simhash-classes")
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    pick = stays.groupBy("root").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    held = docs.select(F.struct("*").alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    kept = held.join(pick.select("key"), "key", "left_semi")
    again = landed(pick.filter(F.col("n") > 1).select("key"), "simhash-again")
    single = kept.join(again, "key", "left_anti")
    one = kept.join(again, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
    return single.select("row.*").unionByName(one.select("row.*"))
