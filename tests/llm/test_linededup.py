import random

import pytest
from pyspark.sql import functions as F

from slicewise.llm import linededup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def edited(rng, s, n, letters):
    s = list(s)
    for _ in range(n):
        at, what = rng.randrange(len(s) + 1), rng.random()
        if what < 0.4 and at < len(s):
            s[at] = rng.choice(letters)
        elif what < 0.7:
            s.insert(at, rng.choice(letters))
        elif s and at < len(s):
            del s[at]
    return "".join(s)


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_edit_test_equals_dynamic_programming(spark, k):
    rng, pairs = random.Random(k), []
    for n in range(1500):
        letters = "ab" if n % 2 else "aé𝒳b c"
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 14)))
        pairs.append((a, edited(rng, a, rng.randrange(0, 5), letters)))
    pairs += [("", ""), ("a", ""), ("ab", "ba"), ("x" * 300 + "a", "a" + "x" * 300), ("a" * 500, "a" * 502)]
    got = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", L.within_edits(F.col("a"), F.col("b"), k).alias("near"),
        (F.least(F.length("a"), F.length("b")) >= 0).alias("any")).collect()
    assert [r for r in got if r.near != (distance(r.a, r.b) <= k)] == []


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(*span))) for span in ((1, 14), (10, 30), (20, 60))
            for _ in range(25)]
    return [(i, "\n".join(edited(rng, rng.choice(base), rng.randrange(0, 4), "abcdefgh é")
                          for _ in range(rng.randrange(0, 12)))) for i in range(n)]


def brute(docs, k, per_edit):
    lines = sorted({x for _, t in docs if t is not None for x in t.split("\n") if x.strip(" ")})
    up, links = {x: x for x in lines}, set()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            most = min(k, min(len(a), len(b)) // per_edit)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                links.add((a, b))
                up[find(a)] = find(b)
    return {x: find(x) for x in lines}, links


@pytest.mark.parametrize("k, per_edit, bound", [(1, 12, 500_000), (2, 12, 500_000), (2, 12, 0), (3, 5, 500_000)])
def test_classes_equal_brute_force(spark, k, per_edit, bound):
    docs = corpus(k)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    links = L.line_links(L._lines(df, "doc_id", "text"), k, per_edit, bound).count()
    root, want = brute(docs, k, per_edit)
    assert links == len(want) > 20
    rows = L.line_classes(df, k, per_edit).orderBy("id", "line_no").collect()
    assert len(rows) == sum(len(t.split("\n")) for _, t in docs)
    text, seen, by_class = dict(docs), set(), {}
    for r in rows:
        line = text[r.id].split("\n")[r.line_no]
        if not line.strip(" "):
            assert r.class_id is None and r.kept and r.n_links == 0
            continue
        assert r.n_links == sum(line in pair for pair in want)
        assert by_class.setdefault(r.class_id, root[line]) == root[line]
        assert r.kept == (root[line] not in seen)
        seen.add(root[line])
    assert len(by_class) == len(set(root.values()))


def test_edge_rows_and_clashing_columns(spark):
    line = "this line is long enough to count"
    rows = [(1, line + "\nown line of the first document", "x", 0, "g"), (2, line, "y", 0, "g"),
            (None, line + "!", "z", 0, "g"), (3, None, None, None, None), (4, "", "e", 0, "g"),
            (5, "short\nshort\n\nsHort\n \n ", "s", 0, "g"), (7, "short\r\nown\r\n" + line + "\r", "r", 0, "g"), (6, "w" * 30_000 + "\n" + line + "?", "l", 0, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n_chars long, gone string")
    got = {r.doc_id: r for r in L.dedup_lines(df).collect()}
    assert set(got) == {1, 3, 4, 5, 6, 7}
    assert got[5].text == "short\n\nsHort\n \n " and got[7].text == "own\r"
    assert got[1].text == rows[0][1] and got[3].text is None and got[4].text == ""
    assert got[6].text == "w" * 30_000 and got[6].n_chars == 30_000 and got[6].key == "l"
    assert L.dedup_lines(df.limit(0)).collect() == [] and df.columns == L.dedup_lines(df.limit(0)).columns


def test_an_edit_changes_four_bits_of_a_sketch_at_most(spark):
    rng, pairs = random.Random(4), []
    for n in range(1500):
        letters, edits = ("ab", "aé𝒳b c", "abcdefgh ")[n % 3], rng.randrange(0, 4)
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))
        pairs.append((a, edited(rng, a, edits, letters), edits))
    pairs += [("", "a", 1), ("a", "b", 1), ("ab", "a", 1)]
    bits = F.bit_count(L._sketch(F.col("a")).bitwiseXOR(L._sketch(F.col("b"))))
    got = spark.createDataFrame(pairs, "a string, b string, n int").select("a", "b", "n", bits.alias("bits")).collect()
    assert [r for r in got if r.bits > 4 * r.n] == []
    long = spark.createDataFrame([("x" * 400_000 + "y",)], "a string")      # a line is encoded once, not once a character
    assert long.select(L._sketch(F.col("a")).alias("s")).first().s != 0


def test_pairs_of_a_common_segment_are_told_apart_without_interpreted_folds(spark):
    """Lines that share one segment and little else: the join's condition runs on every pair of them,
    so it holds compiled functions only, and the sketches leave few pairs to the distance."""
    rng = random.Random(6)
    lines = ["read more here now: " + "".join(rng.choice("abcdefgh ") for _ in range(40)) for _ in range(400)]
    lines += [x + "!" for x in lines[:5]]
    df = spark.createDataFrame([(x, len(x)) for x in lines], "line string, n int")
    links = L.line_links(df)
    assert links.count() == 5
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.split("\n") if "Join Inner" in x)
    assert "levenshtein" in join and "bit_count" in join and "lambda" not in join
