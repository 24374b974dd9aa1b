import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def plain(turns, trained="assistant"):
    """The formatted string and the trained texts, one turn at a time."""
    esc = lambda s: s.replace("\\", "\\b").replace("#", "\\h").replace("<", "\\l").replace(":", "\\c")
    out, masked, prior = "", [], ()
    for role, text in turns:
        if (role,) != prior:
            out += ("\n" if out else "") + "### " + ("\\0" if role is None else esc(role)) + ": "
        if role == trained:
            masked.append(text)
        out += esc(text) + "</turn>"
        prior = (role,)
    return out + "\n", masked


@pytest.fixture(scope="module")
def chats(spark):
    random.seed(4)
    parts = ["\\", "#", "### Assistant: ", "</turn>", "\n", "<", ":", "\\b", "\\0", "é\U0001f600", "plain text ", ""]
    roles = ["user", "assistant", "assistant", "system", None, "odd: #role<\\", "", "\\0"]
    rows = {}
    for conv in range(60):
        rows[conv] = [(t, random.choice(roles), "".join(random.choices(parts, k=random.randint(0, 6)))) for t in range(random.randint(1, 9))]
    flat = [(c, t, r, x) for c, own in rows.items() for t, r, x in own]
    random.shuffle(flat)
    return rows, spark.createDataFrame(flat, TURNS).selectExpr("*", "'x' AS _turns", "'y' AS formatted")


def test_formats_and_reads_back(chats):
    rows, frame = chats
    formatted = chat.format_chats(frame)
    read = {r.conv_id: r for r in chat.read_chats(formatted).collect()}
    made = {r.conv_id: r for r in formatted.collect()}
    assert set(read) == set(rows)
    for conv, own in rows.items():
        turns = [(r, x) for _, r, x in own]
        want, masked = plain(turns)
        assert made[conv].formatted == want
        assert [tuple(t) for t in read[conv].turns] == turns
        assert read[conv].loss_text == "".join(masked)
        assert made[conv].n_turns == len(turns)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="\\bhlc0#<:a", max_size=12))
def test_escapes_are_reversible(text):
    esc = text
    for raw, code in chat.ESCAPES:
        esc = esc.replace(raw, code)
    assert not set(esc) & set("#<:")
    for raw, code in reversed(chat.ESCAPES):
        esc = esc.replace(code, raw)
    assert esc == text


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (2, 5, "assistant", "z" * 200_000)]
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, TURNS))).collect()}
    assert [tuple(t) for t in got[None].turns] == [(None, ""), ("user", "")]
    assert [tuple(t) for t in got[1].turns] == [("assistant", "b"), ("user", "a"), ("user", "a")]
    assert len(got[2].loss_text) == 200_000
    assert chat.format_chats(spark.createDataFrame([], TURNS)).collect() == []
