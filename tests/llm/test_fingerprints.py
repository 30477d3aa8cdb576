import hashlib
import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from slicewise.llm import fingerprints as P

DOCS = "doc_id long, text string, lang string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(text):
    words = lowered(text)
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    votes, total = [0] * 64, 0
    for w in words.split(" "):
        if w:
            h, weight = xxhash.xxh64_intdigest(w.encode(), 42), min(len(w), 15)
            total += weight
            for b in range(64):
                votes[b] += weight * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def apart(a, b):
    return bin(a ^ b).count("1")


def like(a, b):
    return max(0.0, math.cos(math.pi * apart(a, b) / 64)) if apart(a, b) < 32 else 0.0


def expected(rows):
    """Rows of the report by plain means: a sorted list, each text against the one behind it."""
    rows = [(i, t or "") for i, t, *_ in rows]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    prints = [plain(t) for _, t in order]
    out = []
    for k, (i, t) in enumerate(order):
        j = (k + 1) % len(order)
        m = len(t) // 4
        edited = t[:len(t) - m] + order[j][1][:m]
        near = {p for p in prints if apart(p, prints[k]) <= P.RADIUS}
        ids = [r[0] for r, p in zip(order, prints) if p in near and r[0] is not None]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[k]:016x}", f"{plain(edited):016x}",
                    round(like(prints[k], plain(edited)), 9), round(like(prints[k], prints[j]), 9), len(near) - 1,
                    min(ids) if ids else None))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9),
                    round(r.near_next, 9), r.n_near, r.least_near) for r in df.collect()), key=str)


def corpus(seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(50):
        words = [rng.choice("abcdeÉß日") * rng.randrange(1, 22) + str(rng.randrange(400)) for _ in range(rng.randrange(0, 90))]
        rows.append((i * 7 - 60, rng.choice([" ", "\t", "\n\x0b"]).join(words), "en"))
        if words and i % 4 == 0:
            words[-1] = "Z" * rng.randrange(1, 3)
            rows.append((i * 7 - 59, " ".join(words), "en"))
    long = " ".join(f"tok{rng.randrange(5000)}" for _ in range(9000))
    return rows + [(900, None, "x"), (901, "", "x"), (902, " \n", "x"), (903, "One", "x"), (904, "abcd", "x"),
                   (905, long, "x"), (906, long + " end", "x"), (907, "w" * 50000, None), (None, "no id here", "x"),
                   (None, None, None), rows[3], rows[3], (rows[3][0], "another text of that id", "x")]


@pytest.mark.parametrize("range_chars", [1 << 25, 4000, 50])
def test_report_equals_plain_version(spark, range_chars):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert shown(P.report(df, range_chars=range_chars)) == expected(rows)


def test_few_documents_and_clashing_names(spark):
    assert P.report(spark.createDataFrame([], DOCS)).collect() == []
    one = [(5, "only one text stands here", "en")]
    assert shown(P.report(spark.createDataFrame(one, DOCS))) == expected(one)
    rows = [(i, f"text number {i}", 1, 2, 3, 4, 5) for i in range(4)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, fp long, range int, nth int, halo int, next int")
    assert shown(P.report(odd, range_chars=10)) == expected(rows)
    nobody = [(None, "a b", "x"), (None, "a c", "x")]
    assert shown(P.report(spark.createDataFrame(nobody, DOCS))) == expected(nobody)


@pytest.mark.parametrize("radius,blocks,slot_rows", [(3, None, 2000), (3, 6, 3), (0, None, 2), (5, 8, 5)])
def test_all_near_pairs_are_found_once(spark, radius, blocks, slot_rows):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)]
    family = {0, 2 ** 64 - 1}
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.randrange(64)
            family.add(x)
    signed = {x - 2 ** 64 if x >> 63 else x: x for x in family}
    df = P.landed(spark.createDataFrame([(s, 1) for s in signed], "fp long, t int"), "test")
    got = [(frozenset((signed[r.x.fp], signed[r.y.fp])), r.distance) for r in P.near_pairs(df, radius, blocks, slot_rows).collect()]
    want = {frozenset((a, b)): apart(a, b) for a in family for b in family if a < b and apart(a, b) <= radius}
    assert len(got) == len(want) and dict(got) == want


def test_likeness_tells_edits_from_other_texts(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") + str(rng.randrange(3000)) for _ in range(200)), "en")
            for i in range(300)]
    r = P.report(spark.createDataFrame(rows, DOCS)).agg(F.avg("near_edited").alias("a"), F.avg("near_next").alias("b"),
                                                        F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("c")).first()
    assert r.a > 0.6 and r.b < 0.2 and r.c > 0.98
