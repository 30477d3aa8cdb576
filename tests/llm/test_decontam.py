import hashlib
import random
import re

import pytest

from slicewise.llm import decontam as D

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, n):
    out = []
    for i, t in docs:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for item, text in items:
            b = WORD.findall(low(text))
            m = min(n, len(b))
            wins = {tuple(b[k:k + m]) for k in range(len(b) - m + 1)} if m else set()
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in wins:
                    hit.update(range(k, k + m))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("n, bound", [(10, 10 ** 6), (10, 0), (4, 10 ** 6), (3, 10 ** 6)])
def test_report_equals_brute_force(spark, monkeypatch, n, bound):
    rng = random.Random(n)
    vocab = ["alpha", "Beta", "gamma", "3", "été"]
    say = lambda k: " ".join(rng.choice(vocab) + rng.choice(["", ",", " -"]) for _ in range(k))
    items = [(i, say(rng.randrange(1, 2 * n))) for i in range(10)] + [(10, None), (11, "!!"), (2, say(n))]
    docs = [(i, say(rng.randrange(0, 60))) for i in range(40)]
    docs += [(100 + i, say(5) + " " + t + "; " + say(4)) for i, t in items if t]
    docs += [(200, None), (201, ""), (202, "..."), (203, say(3000)), (100, docs[40][1]), (100, docs[40][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D.hits, "__defaults__", (*D.hits.__defaults__[:-1], bound))
    got = sorted(tuple(r) for r in D.report(d, b, n).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == brute(docs, items, n)
    assert sum(r[5] for r in got) > 8


def test_removal_of_documents_and_spans(spark):
    leak = "one two three four five six seven eight nine ten"
    rows = [(1, f"Before, {leak.upper()}! after.", "k1", 1), (2, "Clean text.", "k2", 2), (3, None, None, None), (4, leak, "k", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, key string, hit int")
    b = spark.createDataFrame([(7, leak)], "item_id long, text string")
    kept = D.drop_documents(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    cut = {r.doc_id: r for r in D.remove_spans(d, b).collect()}
    assert (cut[1].text, cut[2].text, cut[3].text, cut[4].text) == ("Before, after.", "Clean text.", None, "")
    assert cut[1].key == "k1" and cut[1].hit == 1
    assert D.report(d.limit(0), b).collect() == []
    assert [r.n_hit for r in D.report(d, b.limit(0)).collect()] == [0] * 4
