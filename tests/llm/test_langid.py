import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from slicewise.llm import langid as G

STEMS = {"en": ["the", "and", "thing", "with", "house"], "de": ["der", "und", "schön", "über", "straße"], "fr": ["le", "être", "français", "où", "et"]}


def corpus(n=400, seed=2):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(sorted(STEMS))
        rows.append((i, " ".join(rng.choices(STEMS[lang], k=rng.randrange(3, 40))), lang, "s", lang))
    return rows


def test_held_out_accuracy_and_edge_rows(spark):
    rows = corpus() + [(1000, None, "en", "s", None), (1001, "", "de", "s", None), (1002, "123 !!", None, "s", None),
                       (None, "the thing and the house", "fr", "s", None), (1003, "der und " * 40_000, None, None, None), (5, corpus()[5][1], corpus()[5][2], "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lang_pred string")
    got = G.report(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "de" and by[None].lang_pred == "en"
    out = [(by[i].lang_pred, lang) for i, _, lang, _, _ in rows[:400] if by[i].held_out]
    assert len(out) > 100 and np.mean([a == b for a, b in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    kept = G.keep_known(df)
    assert kept.columns == df.columns and {1000, 1001, 1002}.isdisjoint({r.doc_id for r in kept.collect()})


def test_labels_of_the_held_out_part_change_nothing(spark):
    rows = corpus(150)
    other = [(i, t, "fr" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s, x) for i, t, lang, s, x in rows]
    schema = "doc_id long, text string, lang string, source string, x string"
    a, b = (sorted(map(tuple, G.report(spark.createDataFrame(r, schema)).collect())) for r in (rows, other))
    assert a == b


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in G.report(df).collect()] == [("und", 0.0)]
    assert G.report(df.limit(0)).collect() == []


def test_penalty_makes_weights_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        y = int(rng.integers(3))
        rows.append((np.unique(np.append(rng.integers(0, 200, 5), 300 + y)), None, y))
    rows = [(f, np.ones(len(f)), y) for f, _, y in rows]
    loose, bias = G.ftrl(rows, 3, 512, l1=0.0)
    tight, _ = G.ftrl(rows, 3, 512, l1=2.0)
    assert (tight != 0).mean() < (loose != 0).mean() and all(tight[300 + y].argmax() == y for y in range(3))
    logits = rng.normal(size=(2000, 3)) * 2
    y = np.array([rng.choice(3, p=G._softmax(z)) for z in logits])
    assert 0.85 < G.temperature(logits, y) < 1.15 and 3.4 < G.temperature(logits * 4, y) < 4.6


MASK = (1 << 64) - 1


def plain_features(text):
    """All n-grams of the folded text as feature numbers, by strings and whole numbers."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    s = " " + re.sub(" +", " ", low).lstrip(" ") + " "
    out = []
    for n in G.ORDERS:
        for i in range(len(s) - n + 1):
            h = n
            for c in s[i:i + n]:
                h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 & MASK
                h ^= h >> 29
            out.append((h * 0x9E3779B97F4A7C15 & MASK) >> (64 - G.DIM_BITS))
    return out


def softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def plain_ftrl(rows, k):
    """One coordinate at a time, in dictionaries; the bias is the feature named None."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f, j):
        l1 = 0.0 if f is None else G.L1
        if abs(z[f, j]) <= l1:
            return 0.0
        return -(z[f, j] - math.copysign(l1, z[f, j])) / ((G.BETA + math.sqrt(n[f, j])) / G.ALPHA + G.L2)

    for _ in range(G.EPOCHS):
        for x, y in rows:
            x = {**x, None: 1.0}
            w = {(f, j): weight(f, j) for f in x for j in range(k)}
            p = softmax([sum(v * w[f, j] for f, v in x.items()) for j in range(k)])
            for f, v in x.items():
                for j in range(k):
                    g = v * (p[j] - (j == y))
                    z[f, j] += g - (math.sqrt(n[f, j] + g * g) - math.sqrt(n[f, j])) / G.ALPHA * w[f, j]
                    n[f, j] += g * g
    return weight


def test_model_and_predictions_equal_a_plain_version(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(STEMS[lang if rng.random() < 0.6 else "fr"]) for _ in range(rng.randrange(1, 8))), lang)
            for i, lang in enumerate(rng.choices(sorted(STEMS), k=150))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = G.fit(df)

    langs = sorted(STEMS)
    train = sorted((hashlib.md5(f"+{i}\0+{t}".encode()).hexdigest(), t, langs.index(lang))
                   for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    seen = Counter(f for _, t, _ in train for f in set(plain_features(t)))
    idf = lambda f: math.log((1 + len(train)) / (1 + seen[f])) + 1

    def vector(text):
        c = Counter(plain_features(text))
        return {f: m / sum(c.values()) * idf(f) * G.SCALE for f, m in c.items()}

    data = [(vector(t), y) for _, t, y in train]
    weight = plain_ftrl([r for k, r in enumerate(data) if k % 5], 3)
    logits = lambda x: [sum(v * weight(f, j) for f, v in x.items()) + weight(None, j) for j in range(3)]
    aside = [(logits(x), y) for k, (x, y) in enumerate(data) if k % 5 == 0]
    loss = lambda t: -sum(math.log(max(softmax([v / t for v in z])[y], 1e-12)) for z, y in aside) / len(aside)
    grid = [0.05 * 400 ** (k / 1000) for k in range(1001)]
    assert model.langs == langs and loss(model.temperature) <= min(map(loss, grid)) + 1e-5
    for r in G.report(df).collect():
        p = softmax([v / model.temperature for v in logits(vector(rows[r.doc_id][1]))])
        assert abs(r.score - max(p)) < 1e-3
        assert r.lang_pred == langs[p.index(max(p))] or sorted(p)[-1] - sorted(p)[-2] < 1e-3
