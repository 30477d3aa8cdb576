"""Every stage against a plain version of it, each on what the stage before it kept."""

import hashlib
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_decontam import brute as leaks  # noqa: E402
from test_linededup import brute as line_roots  # noqa: E402
from test_simhash import plain, reach  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from slicewise.llm import langid, linededup, mixing, simhash  # noqa: E402

STEMS = {"en": ["the", "and", "thing", "with", "house", "river", "open"], "de": ["der", "und", "schön", "über", "straße", "fluss"],
         "fr": ["le", "être", "français", "où", "et", "rivière"]}
ITEM = "what is the name of the longest river that runs through all of the northern lands"


def corpus(seed=4):
    rng, rows = random.Random(seed), []

    def line(lang):
        return " ".join(rng.choice(STEMS[lang]) + str(rng.randrange(90)) * (rng.random() < 0.4) for _ in range(rng.randrange(3, 14)))

    shared = {g: [line(g) + " said again and again" for _ in range(3)] for g in STEMS}
    for i in range(120):
        lang = rng.choice(sorted(STEMS))
        lines = [line(lang) for _ in range(rng.randrange(1, 6))]
        if i % 4 == 0:
            lines.append(rng.choice(shared[lang]) + rng.choice(["", "!", "?"]))
        if i % 9 == 0:
            lines.append(f"{line(lang)} {ITEM} {line(lang)}")
        rows.append((i, "\n".join(lines), lang, "big" if i % 3 else f"s{i % 5}"))
    rows += [(200, rows[0][1], "en", "big"), (201, rows[1][1] + " x", "en", "big"), (202, "123 !!", "en", "big"), (203, None, None, None),
             (204, "short", "en", "big"), (205, rows[2][1].replace("a", "b", 1), "de", "big"), (206, "the and thing with\nhouse river open", "en", "big"),
             (207, "The and\nthing with house river\n\nopen", "en", "big")]
    return [(*r, len(r[1] or "")) for r in rows]


def no_lines(rows):
    root, _ = line_roots([(i, t) for i, t, *_ in rows], linededup.MAX_EDITS, linededup.PER_EDIT)
    seen, out = set(), []
    for r in sorted(rows):
        kept = []
        for x in r[1].split("\n"):
            if x not in root or root[x] not in seen:
                kept.append(x)
            seen.add(root.get(x))
        text = "\n".join(kept)
        if text == r[1] or text.strip():
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def one_each(rows):
    rows = sorted(rows)
    root, out, seen = reach([plain(r[1]) for r in rows], simhash.BITS), [], set()
    for r, k in zip(rows, root):
        if k not in seen:
            out.append(r)
        seen.add(k)
    return out


def mixed(rows):
    def topic(t):
        return next((n for n, marks in mixing.TOPIC_MARKS if any(m in t for m in marks)), "long" if len(t) >= mixing.LONG_CHARS else "short")

    cell = {r[0]: (r[3] or mixing.NONE, r[2] or mixing.NONE, topic(r[1])) for r in rows}
    n = {r[0]: len(r[1].split()) for r in rows}
    tokens = {}
    for i, c in cell.items():
        tokens[c] = tokens.get(c, 0) + n[i]
    whole = sum(tokens.values())
    most = {c: v / (whole * mixing.SHARE) for c, v in tokens.items()}
    sums = lambda w, k: {x: sum(v for c, v in w.items() if c[k] == x) for x in {c[k] for c in w}}
    goal = []
    for k, d in enumerate(mixing.DIMS):
        power, have = {x: v ** mixing.TEMPER[d] for x, v in sums(tokens, k).items()}, sums(most, k)
        t, full = {x: v / sum(power.values()) for x, v in power.items()}, set()
        while True:
            up = (1 - sum(have[x] for x in full)) / sum(v for x, v in t.items() if x not in full)
            more = {x for x in t if x not in full and t[x] * up > have[x]}
            if not more:
                break
            full |= more
        goal.append({x: have[x] if x in full else v * up for x, v in t.items()})
    u, rounds = {c: v / whole for c, v in tokens.items()}, 0
    while rounds < mixing.ROUNDS:
        for k in range(3):
            for x, t in goal[k].items():
                mine = [c for c in u if c[k] == x]
                cut = sum(most[c] for c in mine if u[c] >= most[c])
                free = sum(u[c] for c in mine if u[c] < most[c])
                for c in mine:
                    if t > cut and free:
                        u[c] *= (t - cut) / free
                    elif t < cut:
                        u[c] = min(u[c], most[c]) * t / (cut + free)
        rounds += 1
        got = {c: min(v, most[c]) for c, v in u.items()}
        if rounds % mixing.BLOCK == 0 and all(abs(v - goal[k][x]) <= mixing.TOLERANCE for k in range(3) for x, v in sums(got, k).items()):
            break
    out = []
    for r in rows:
        c = cell[r[0]]
        p = min(u[c], most[c]) / most[c]
        drawn = int(hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()[:13], 16) / 2 ** 52
        if drawn < p:
            out.append(r)
    return out


@pytest.fixture(scope="module")
def table(tmp_path_factory, spark):
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_equal_their_plain_versions(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    columns, rows = docs.columns, sorted(map(tuple, docs.collect()), key=lambda r: r[0])
    model = langid.fit(docs)

    def known(rows):
        got = [(r, model.predict(r[1])) for r in rows]
        return [r for r, (lang, score) in got if lang != "und" and score >= 0.5]

    def clean(rows):
        bad = {r[0] for r in leaks([(r[0], r[1]) for r in rows], [(1, ITEM), (2, None)], 10) if r[5]}
        return [r for r in rows if r[0] not in bad]

    plain_versions = [known, no_lines, one_each, clean, mixed]
    sizes = [len(rows)]
    for (name, stage), version in zip(P.STAGES, plain_versions, strict=True):
        docs = linededup.landed(stage(spark, docs, table), "stage")
        want = version(rows)
        rows = sorted(map(tuple, docs.collect()))
        assert docs.columns == columns
        assert rows == sorted(want), name
        sizes.append(len(rows))
    assert all(a > b for a, b in zip(sizes, sizes[1:])), sizes
    assert sorted(map(tuple, P.run(spark, table).collect())) == rows


def test_empty_table(spark, table, tmp_path):
    spark.read.parquet(f"{table}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{table}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
