import random
from collections import Counter, defaultdict
from itertools import permutations

from slicewise.llm import filteraudit as A

DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"


def words(text):
    for blank in "\t\n\x0b\x0c\r":
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def plain(docs, labels):
    """Filters applied one after the other, for every order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang, *_ in docs:
        text = text or ""
        w = words(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
                 "D": any(c in "#$%&*|" for c in text),
                 "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs)}
        rows.append((lang or "", i, {k for k, v in fails.items() if v}))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left, gone = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[2]]
                redundant = sum(f in r[2] for r in gone)
                left = [r for r in left if f not in r[2]]
                gone += here
                shapley[part, f] += len(here)
                out[part, "".join(order), step] = [
                    len(left), len(here), redundant, sum(r[2] == {f} for r in rows if r[0] == part),
                    sum(r[1] in good for r in here), sum(r[1] in toxic for r in here), f]
    return {k: (*v[:-1], shapley[k[0], v[-1]]) for k, v in out.items()}


def shown(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost,
                                               r.toxic_lost, r.shapley) for r in df.collect()}


def corpus(seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        size = rng.choice([0, 5, 150, 199, 200, 260])
        pool = [f"w{k}" for k in range(rng.choice([90, 100, 3000]))] + ["Cap"] * rng.choice([0, 400])
        text = rng.choice([" ", "\t", "\x0b\n"]).join(rng.choice(pool) for _ in range(size))
        text += rng.choice(["", "", " 5 %", " a|b"])
        rows.append((i * 2, text, rng.choice(["en", "fr", None]), "web"))
        if i % 4 == 0:
            rows.append((rng.choice([i * 2 + 1, 999 - i]), text, rng.choice(["en", ""]), "copy"))
    twin = rows[3]
    return rows + [(500, None, "en", "x"), (501, "", None, "x"), (502, "", "en", "x"), (None, rows[0][1], "fr", "x"),
                   (None, None, "fr", "x"), twin, twin, (twin[0], "other text", "en", "x"),
                   (700, " ".join("one" for _ in range(30000)), "xx", None)]


def test_equal_to_filters_applied_in_turn(spark):
    docs = corpus()
    labels = ([(i, i % 3 % 2, i % 5 == 0) for i in range(0, 60)] + [(4, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1)])
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    got = A.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    want = plain(docs, labels)
    assert shown(got) == want
    assert dict(got.dtypes)["step"] == "int" and dict(got.dtypes)["shapley"] == "bigint"
    by_part = defaultdict(set)
    for part, order, step in want:
        by_part[part].add((order, step))
    assert {len(v) for v in by_part.values()} == {600}


def test_one_text_holds_most_rows(spark):
    docs = [(i, "same words here", "en", "hot") for i in range(2000)] + [(i, f"own {i}", "en", "hot") for i in range(2000, 2500)]
    got = shown(A.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)))
    assert got["en", "EABCD", 1] == (501, 1999, 0, 0, 0, 0, 1999 * 60)
    assert got["en", "AEBCD", 2][:3] == (0, 0, 1999)


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], DOCS)
    assert A.audit(none, spark.createDataFrame([], LABELS)).collect() == []
    odd = spark.createDataFrame([(1, "a", "en", 3, 4, 5, "k"), (2, "a", "en", 3, 4, 5, "k")],
                                "doc_id long, text string, lang string, h int, n int, mask int, key string")
    assert shown(A.audit(odd, spark.createDataFrame([], LABELS)))["en", "EABCD", 1][:2] == (1, 1)
