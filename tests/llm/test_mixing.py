import pytest
from pyspark.sql import functions as F

from slicewise.llm import mixing as M


def docs(spark):
    rows = []
    for i in range(600):
        src, lang = ("big" if i % 3 else f"s{i % 7}"), ("en" if i % 4 else "de")
        rows.append((i, "word " * (1 + i % 50) + ("|" if i % 5 == 0 else ""), lang, src, "t"))
    rows += [(900, None, None, None, None), (901, "", "en", "big", "t"), (902, "one", None, "big", None), (902, "one", None, "big", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, p string")


def test_raked_weights_meet_given_marginals(spark):
    cells = spark.createDataFrame([(s, g, t, 10 * (i + 1)) for i, (s, g, t) in enumerate(
        (s, g, t) for s in "ab" for g in ("en", "de") for t in ("x", "y"))], "source string, lang string, topic string, tokens long")
    want = {"source": {"a": 3, "b": 1}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 0.2, "y": 0.8}}
    raked = M.rake(cells, want, tolerance=1e-10)
    for d, shares in want.items():
        got = {r[d]: r.w for r in raked.groupBy(d).agg(F.sum("weight").alias("w")).collect()}
        assert got == pytest.approx({k: v / sum(shares.values()) for k, v in shares.items()}, abs=1e-9)


def test_plan_covers_every_row_and_decides_by_id(spark):
    df = docs(spark)
    rows = M.plan(df).collect()
    assert len(rows) == 604
    by = {r.doc_id: r for r in rows}
    assert by[900].n_tokens == 0 and by[900].p == 0 and not by[900].sampled and by[900].source == M.NONE
    assert by[901].p == 0 and by[902].p > 0 and by[902].lang == M.NONE
    assert all(0 <= r.p <= 1 and abs(r.p - min(1, r.ratio * M.SHARE)) < 1e-8 for r in rows)
    again = {(r.doc_id, r.sampled) for r in M.plan(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.sampled) for r in rows}
    kept = M.sample(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.sampled)
    assert M.plan(df.limit(0)).collect() == [] and M.sample(df.limit(0)).collect() == []


def test_expected_mix_follows_the_targets(spark):
    rows = [r for r in M.plan(docs(spark), temper={"source": 0.0, "lang": 1.0, "topic": 1.0}, share=0.1).collect() if r.n_tokens]
    part = {}
    for r in rows:
        part[r.source] = part.get(r.source, 0) + r.n_tokens * r.p
    total = sum(part.values())
    assert len(part) == 8 and max(part.values()) / total == pytest.approx(1 / 8, rel=0.25)


def test_cells_beyond_their_tokens_are_taken_whole(spark):
    # "rare" is asked for at a third of the sample and has a tenth of the tokens
    rows = [(i, "word " * 100, "en" if i % 3 else "de", "rare" if i % 10 == 0 else ("left" if i % 2 else "right")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    goal = dict(targets={"source": {"rare": 1, "left": 1, "right": 1}}, temper={"source": 1.0, "lang": 0.0, "topic": 1.0})
    planned = M.plan(df, share=0.5, **goal).collect()
    assert all(r.p == 1 and r.sampled for r in planned if r.source == "rare")
    assert sum(r.p * r.n_tokens for r in planned) == pytest.approx(15_000, rel=1e-5)
    got = {(r.dimension, r.category): r for r in M.balance(df, share=0.5, **goal).collect()}
    assert got["source", "rare"].target == pytest.approx(0.2) and got["source", "left"].target == pytest.approx(0.4)
    assert got["lang", "de"].target == pytest.approx(0.5)
    assert all(abs(r.expected - r.target) < 1e-3 * r.target for r in got.values())
    assert M.balance(df.limit(0)).collect() == []


def test_expected_mix_at_the_production_share(spark):
    assert all(abs(r.expected - r.target) < 1e-3 * r.target for r in M.balance(docs(spark)).collect())
