import math
import random
from collections import Counter

from slicewise.llm import quality as Q
from slicewise.sinks.tables import batches_within, shuffles_dropped


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    return [(i, " ".join(rng.choices(vocab, weights, k=rng.randrange(0, 40))), "en" if i % 3 else "de")
            for i in range(n)]


def plain_log_ppl(train, texts):
    """Interpolated modified Kneser-Ney of order two, computed in the textbook form."""
    chain = lambda t: ["<s>"] + [w.lower() for w in (t or "").split()] + ["</s>"]
    pairs = Counter(p for t in train for p in zip(chain(t), chain(t)[1:]))
    spread = Counter(min(c, 5) for c in pairs.values())
    d = Q._discounts([spread[k] for k in (1, 2, 3, 4)])
    total, left, cont = Counter(), Counter(), Counter()
    for (u, w), c in pairs.items():
        total[u] += c
        left[u] += d[min(c, 3) - 1]
        cont[w] += 1
    low = Counter(min(n, 5) for n in cont.values())
    d1 = Q._discounts([low[k] for k in (1, 2, 3, 4)])
    all_pairs = sum(cont.values())
    floor = sum(d1[min(n, 3) - 1] for n in cont.values()) / all_pairs / (len(cont) + 1)

    def prob(u, w):
        beta = floor + ((cont[w] - d1[min(cont[w], 3) - 1]) / all_pairs if w in cont else 0)
        if u not in total:
            return beta
        own = max(pairs[u, w] - d[min(pairs[u, w], 3) - 1], 0) if (u, w) in pairs else 0
        return (own + left[u] * beta) / total[u]

    # it is a distribution: known words plus one unknown sum to one in every context
    for u in list(total)[:5]:
        assert abs(sum(prob(u, w) for w in cont) + prob(u, "never") - 1) < 1e-9
    return [-sum(math.log(prob(u, w)) for u, w in zip(chain(t), chain(t)[1:])) / (len(chain(t)) - 1) for t in texts]


def test_log_perplexity_equals_textbook_form(spark):
    rows = corpus() + [(900, None, "en"), (901, "", None), (902, "Never SEEN words", "en"), (903, "w0 W1 new", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 30)] + [(30, 1, 1), (31, 0, 0), (None, 1, 0), (5, 1, None)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    want = plain_log_ppl([t for i, t, _ in rows if i < 30], [t for _, t, _ in rows])
    assert len(got) == len(rows)
    for (i, t, _), w in zip(rows, want):
        assert abs(got[i].log_ppl - w) < 1e-5, i
        assert got[i].n_words == len((t or "").split())
    for lang in ("en", "de"):
        outside = sorted(w for (i, _, x), w in zip(rows, want) if x == lang and i >= 30)
        bins = [round(w / Q.BIN) for w in outside]
        edge = next(b for k, b in enumerate(bins, 1) if k >= Q.QUANTILE * len(bins))
        limit = [got[i].threshold for i, _, x in rows if x == lang]
        assert max(limit) == min(limit) and abs(limit[0] - (edge + 0.5) * Q.BIN) < 2 * Q.BIN
    assert all(r.keep == (r.log_ppl <= r.threshold) for r in got.values())


def test_without_trusted_documents_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 0)], "doc_id long, text string, lang string, v int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in Q.judge(docs, none).collect()] == [(1, "en", None, None, None, True)]
    assert Q.judge(docs.limit(0), none).collect() == []
    twice = docs.union(docs).union(spark.createDataFrame([(2, "a c", "en", 0)], docs.schema))
    some = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.judge(twice, some).orderBy("doc_id").collect()
    assert len(got) == 3 and got[0] == got[1] and got[0].log_ppl < got[2].log_ppl


def test_slices_and_shards_give_the_same_scores(spark, monkeypatch):
    rows = corpus(seed=9) + [(900, None, "en"), (901, "never seen " + "long" * 9, "en"), (902, "w1 w2\tW1\x0bw2 w1 w2", "de")]
    docs = spark.createDataFrame(rows + rows[-3:], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    whole = sorted(map(tuple, Q.judge(docs, labels).collect()))
    monkeypatch.setattr(Q, "SLICE_ROWS", 500)
    monkeypatch.setattr(Q, "SHARD_ROWS", 20)
    monkeypatch.setattr(Q, "SCORE_SLICES", 3)
    assert sorted(map(tuple, Q.judge(docs, labels).collect())) == whole
    want = plain_log_ppl([t for i, t, _ in rows if i < 60 and i % 2 == 0], [t for _, t, _ in rows])
    got = {r[0]: r[3] for r in whole}
    assert all(abs(got[i] - w) < 1e-5 for (i, _, _), w in zip(rows, want))


def test_every_slice_holds_its_share_of_the_pairs(spark):
    """Disk is bounded because no slice shuffles more than its share, and none is shuffled twice."""
    docs = spark.createDataFrame([(" ".join(f"a{i * 7919 % 3001} b{i}" for i in range(2000)),)], "text string")
    parts = [Q.pair_counts(docs, k, 8).collect() for k in range(8)]
    pairs = [(r.u, r.w) for part in parts for r in part]
    assert len(pairs) == len(set(pairs)) and sum(r.c for part in parts for r in part) == 4001
    assert max(map(len, parts)) < 2 * len(pairs) / 8
    whole = {(r.u, r.w): r.c for r in Q.pair_counts(docs).collect()}
    assert whole == {(r.u, r.w): r.c for part in parts for r in part}


def test_words_are_hashed_as_split_and_lowered():
    texts = ["Ab\tcd  E\u00c9 \u00e9\x0b\x0cx\r\n", "", "  ", "x" * 8 + " " + "x" * 9 + " " + "X" * 17 + " a\x00 a", "ab"]
    raws = [t.encode() for t in texts]
    h, n = Q.word_hashes(raws)
    words = [w for r in raws for w in r.lower().split()]
    assert n.tolist() == [len(r.lower().split()) for r in raws] and len(h) == len(words)
    assert len({(a, b) for a, b in zip(words, h.tolist())}) == len(set(words)) == len(set(h.tolist()))


def test_shuffles_are_dropped_within_and_the_setting_comes_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before


def test_pairs_travel_in_blocks_and_are_counted_exactly(spark, monkeypatch):
    """No pair is a row of a shuffle: rows between tasks are bounded by batches and shards."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", *(f"w{i}" for i in range(400))], [200] + [1] * 400, k=50)) for _ in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string").repartition(3)
    plan = Q.pair_counts(docs, 0, 1, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    assert Q._pair_blocks(docs, 0, 1, 7).count() <= 3 * 7
    chains = [[Q._START, *Q.word_hashes([(t or "").encode()])[0], Q._END] for t in [*texts, None, ""]]
    want = Counter((int(u), int(w)) for chain in chains for u, w in zip(chain, chain[1:]))
    unsigned = lambda x: x % (1 << 64)
    for shards, block in ((1, 1 << 20), (7, 1 << 20), (7, 1)):
        monkeypatch.setattr(Q, "BLOCK_PAIRS", block)
        with batches_within(spark, 3000):
            got = Q.pair_counts(docs, 0, 1, shards).collect()
        assert len(got) == len(want) and {(unsigned(r.u), unsigned(r.w)): r.c for r in got} == want


def test_long_texts_reach_the_workers_in_bounded_batches(spark):
    docs = spark.createDataFrame([("x" * 1000,)] * 200, "text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield b.assign(n=len(b))[["n"]]

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    with batches_within(spark, 20_000):
        assert max(r.n for r in docs.mapInPandas(sizes, "n long").collect()) <= 25
    assert spark.conf.get(key, None) == before


def test_word_sums_equal_a_plain_count(spark):
    texts = ["a b a b a c", "b a", "", "a a a a a a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    name = {int(Q.word_hashes([w.encode()])[0][0]): w for w in ("a", "b", "c", Q.START, Q.END)}
    pairs = Counter(p for t in texts for p in zip([Q.START, *t.split()], [*t.split(), Q.END]))
    for slices, shards in ((1, 1), (3, 5)):
        got = {name[r.h % (1 << 64)]: tuple(r)[1:] for r in Q._word_counts(docs, slices, shards).collect()}
        assert len(got) == 5
        for word, sums in got.items():
            led = [c for (u, _), c in pairs.items() if u == word]
            assert sums == (sum(led), *(led.count(i) for i in (1, 2, 3, 4)), len(led), sum(w == word for _, w in pairs))
