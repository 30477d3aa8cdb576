import random

import numpy as np
import pytest
import xxhash

from slicewise.llm import simhash as S


def plain(text, shingle=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(fps, bits):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2 ** 64 - 1)).count("1") <= bits:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_trie_pairs_are_all_pairs(bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    near = [b ^ (np.uint64(1) << np.uint64(rng.integers(64))) ^ (np.uint64(1) << np.uint64(rng.integers(64)))
            for b in base for _ in range(5)]
    keys = np.unique(np.concatenate([base, np.array(near, np.uint64), np.array([0, 2 ** 64 - 1], np.uint64)]))
    a, b = keys[::2], keys[1::2]
    dist = lambda x, y: np.bitwise_count(x[:, None] ^ y[None])
    got = sorted((int(u), int(v)) for us, vs in S.trie_pairs(a, b, bits) for u, v in zip(us, vs))
    assert got == sorted(map(tuple, np.argwhere(dist(a, b) <= bits).tolist()))
    own = sorted((int(u), int(v)) for us, vs in S.trie_pairs(keys, None, bits) for u, v in zip(us, vs))
    assert own == sorted((i, j) for i, j in np.argwhere(dist(keys, keys) <= bits).tolist() if i < j)


def docs(seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 120))]
        rows.append((i * 3, " ".join(words)))
        if i % 3 == 0 and words:
            words[rng.randrange(len(words))] = "Other"
            rows.append((i * 3 + 1, "\t".join(words)))
            rows.append((i * 3 + 2, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one two"), (905, "É é\x0bx y z")]


@pytest.mark.parametrize("bucket", [32768, 8])
def test_components_equal_brute_force(spark, bucket):
    rows = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r.doc_id: r.fp & (2 ** 64 - 1) for r in S.fingerprints(df).collect()}
    assert prints == {i: plain(t) for i, t in rows}
    ids = sorted(prints)
    root = reach([prints[i] for i in ids], S.BITS)
    least = {}
    for i, r in zip(ids, root):
        least.setdefault(r, i)
    distinct = S.landed(S.fingerprints(df).groupBy("fp").count().select("fp"), "t")
    got = S.components(S.links(distinct, S.BITS, bucket))
    up = {r.node: r.root for r in got.collect()}
    signed = {i: np.array([prints[i]], np.uint64).view(np.int64)[0] for i in ids}
    groups = {}
    for i in ids:
        groups.setdefault(up.get(signed[i], signed[i]), []).append(i)
    want = {}
    for i, r in zip(ids, root):
        want.setdefault(r, []).append(i)
    assert sorted(groups.values()) == sorted(want.values())
    shown = {r.doc_id: r.component_id for r in S.report(df).collect()}
    assert shown == {i: least[r] for i, r in zip(ids, root)}


def test_one_of_each_stays(spark):
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(2, text, "a"), (1, text, "b"), (1, text, "b"), (None, text, "c"), (7, "else", "d"), (9, None, "e"), (8, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = S.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.key) for r in got.collect()) == [(1, "b"), (7, "d"), (8, "f")]
    assert S.keep_one(df.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, text), (1, "other words here"), (2, text)], "doc_id long, text string")
    assert sorted(r.text for r in S.keep_one(twice).collect()) == ["other words here", text]
    nobody = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (None, None)], "doc_id long, text string")
    assert len(S.keep_one(nobody).collect()) == 2
