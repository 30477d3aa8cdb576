import hashlib

from hypothesis import given
from hypothesis import strategies as st

from slicewise.llm import chat as C


@given(st.text("\\#<:/turn> é\n", max_size=30))
def test_escape_is_reversible_and_hides_marks(text):
    out = C.escape(text)
    assert C.unescape(out) == text
    bare = out.replace("\\\\", "").replace("\\#", "").replace("\\<", "")
    assert "#" not in bare and "<" not in bare


def test_digest_reads_back_what_was_formatted(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    hard = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", hard, 0), (1, 0, "user", "### User: hi\n", 0), (2, 0, "assistant", "first", 0), (2, 1, None, None, 0),
            (3, 5, "od:d\n#", "x", 0), (3, None, "system", "", 0), (None, 0, "user", "lost", 0), (4, 0, "user", "a", 0), (4, 0, "user", "a", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    got = {r.conv_id: r for r in C.digest(df).collect()}
    want = {1: [("user", "### User: hi\n"), ("assistant", hard)], 2: [("assistant", "first"), ("", "")],
            3: [("system", ""), ("od:d\n#", "x")], None: [("user", "lost")], 4: [("user", "a")] * 2}
    assert set(got) == set(want)
    for conv, turns in want.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{role}\n{t}\n" for role, t in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, None: True, 4: False}
    assert C.digest(df.limit(0)).collect() == []


def test_segments_join_to_the_formatted_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b"), (1, 1, "assistant", "yes" * 9000)], "conv_id long, turn long, role string, text string")
    segs = C.segments(df).orderBy("seq").collect()
    assert "".join(s.content for s in segs) == "### User: a \\< b</turn>\n### Assistant: " + "yes" * 9000 + "</turn>\n"
    assert [s.content for s in segs if s.loss] == ["yes" * 9000]
