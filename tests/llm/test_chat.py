import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from raresift.llm import chat
from raresift.llm.queries import TRICKY

T = chat.Template()
SCHEMA = "conv_id long, turn long, role string, text string, state string, loss int"


def expected(turns):
    """turns: sorted (role, text)."""
    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def run(spark, rows):
    df = spark.createDataFrame([(c, t, r, x, "clash", 1) for c, t, r, x in rows], SCHEMA)
    segments = chat.format_chat(df)
    return {r.conv_id: r for r in chat.read_back(segments).collect()}, segments


@given(st.text(alphabet="\\#<>/turn: \nA😀é"), st.text(alphabet="\\#:</turn>ax"))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text, role):
    quoted = T.quote(text)
    assert T.unquote(quoted) == text and T.unquote(T.quote_role(role)) == role
    before, after = T.open.split("{role}")
    found = T.parse(before + T.quote_role(role) + after + quoted + T.close + T.after)
    assert found and T.unquote(found[1]) == text and T.unquote(found[0]) == role
    assert T.parse(before + T.quote_role(role) + after + quoted + T.close) is None and T.parse("x" + before) is None
    assert "###" not in quoted


def test_digests_loss_and_machine(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "system", "s"), (1, 3, "assistant", TRICKY), (2, 0, "user", "no answer"),
            (3, 0, "assistant", "first"), (4, 0, "user", None), (4, 1, "assistant", ""), (5, 0, None, "x"), (5, 0, None, "x"),
            (6, None, "user", "early"), (6, 1, "assistant", "late"), (7, 0, "user", "q"), (7, 1, "tool", "t"), (7, 2, "assistant", "a" * 100_000)]
    got, segments = run(spark, rows)
    for c in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c))
        want = expected([(r, x) for _, r, x in turns])
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    assert {c for c, r in got.items() if r.accepted} == {1, 4, 6, 7}
    # the loss mask covers exactly the assistant's texts
    texts = {(s.conv_id, s.turn): T.unquote(s.text) for s in segments.filter("loss").collect()}
    assert texts[(1, 3)] == TRICKY and (1, 2) not in texts
    whole = "".join(s.text for s in segments.filter("conv_id = 1").orderBy("segment").collect())
    assert whole == "### system: s</turn>\n### user: b</turn>\n### assistant: " + T.quote(TRICKY) + "</turn>\n"
    assert got[1].formatted_chars == len(whole)


def test_null_conversation_and_empty_table(spark):
    got, _ = run(spark, [(None, 0, "user", "a"), (None, 1, "assistant", "b")])
    assert got[None].n_turns == 2 and got[None].accepted
    assert run(spark, [])[0] == {}


def test_other_template(spark):
    t = chat.Template(open="<|{role}|>", close="<|end|>", marks="|", learned=("user",), final=("user",))
    df = spark.createDataFrame([(1, 0, "user", "a|b<|end|>c")], "conv_id long, turn long, role string, text string")
    row = chat.read_back(chat.format_chat(df, t), t).first()
    assert row.loss_chars == 11 and row.accepted
    assert row.turns_sha256 == hashlib.sha256(b"user\na|b<|end|>c\n").hexdigest()


def test_damage_is_noticed(spark):
    _, segments = run(spark, [(1, 0, "user", "a")])
    broken = segments.withColumn("text", segments.text.substr(2, 100)).coalesce(1)
    with pytest.raises(Exception, match="can't be read back|inside a turn"):
        chat.read_back(broken).collect()


@pytest.mark.parametrize("bad", [{"open": "### x: "}, {"close": ""}, {"escape": "#"}, {"escape": "ab"}, {"marks": "|"}, {"open": "#{role} "}])
def test_templates_that_cannot_be_read_back(bad):
    with pytest.raises(ValueError):
        chat.Template(**bad)


def test_long_turns_take_little_memory(spark):
    import tracemalloc

    text = ("long \\ # </turn> text" * 250000)[:4_000_000]
    before, after = T.open.split("{role}")
    turn = before + "user" + after + T.quote(text) + T.close + T.after
    tracemalloc.start()
    role, found = T.parse(turn)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert role == "user" and T.unquote(found) == text and peak < 3 * len(turn)
    got, _ = run(spark, [(1, 0, "user", text), (1, 1, "assistant", text), (2, 0, "user", "\\" * 3_000_000), (2, 1, "assistant", "")])
    for conv, turns in ((1, [("user", text), ("assistant", text)]), (2, [("user", "\\" * 3_000_000), ("assistant", "")])):
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(turns)
