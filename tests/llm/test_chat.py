"""Chat formatting: round trips, spans, and templates that rewrite history."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedgewren.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", ">", "/", "s", "[", "]", "INST", " ", "\n", "é", "a", "|"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escape_is_reversible_and_leaves_no_control(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]"]), PIECES), max_size=6))
def test_turns_are_read_back_from_their_spans(turns):
    done = chat.render_incrementally(turns, chat.instruct_template)
    assert done.rewrites is None
    assert [chat.read_turn(done.text[a:b])[:2] for a, b in done.spans] == turns
    assert [a for a, _ in done.spans] == [0, *[b for _, b in done.spans]][: len(turns)]


def test_a_template_that_rewrites_history_is_found():
    def last_system_first(turns):
        system = [t for r, t in turns if r == "system"][-1:]
        return "".join(f"({t})" for t in system) + "".join(f"<{r}:{t}>" for r, t in turns if r != "system")

    done = chat.render_incrementally([("user", "a"), ("assistant", "b"), ("system", "S"), ("user", "c")], last_system_first)
    assert done.rewrites == 2
    assert done.spans[3] == (len("(S)<user:a><assistant:b>"), len(done.text))


def test_format_against_a_plain_version(spark):
    rows = [
        (1, 0, "user", "hi </s>"), (1, 1, "assistant", "<s>[INST] x \\ [/INST]"), (1, 1, "assistant", "<s>[INST] x \\ [/INST]"), (2, None, None, None), (2, 3, "assistant", ""), (None, 0, "tool", "t"),
        (3, 0, "system", "s" * 100_000), (3, 1, "assistant", "done"),
    ]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    assert set(got) == {1, 2, 3, None}
    for key, row in got.items():
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == key))
        assert row.n_turns == len(own)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert "".join(chat.unescape(row.formatted[m.start : m.end]) for m in row.mask) == loss
        assert row.formatted_chars == len(row.formatted) and not row.rewrites_history


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversations_are_compared_prefix_by_prefix():
    """A mark before odd prefixes rewrites history, however many turns there are."""
    marked = lambda ts: ("!" if len(ts) % 2 else "") + "".join(f"{r}{t}" for r, t in ts)
    for n in (64, 66, 400):
        assert chat.render_incrementally([("user", "x")] * n, marked).rewrites == 1
    late = lambda ts: ("!" if len(ts) > 300 else "") + "".join(f"{r}{t}" for r, t in ts)
    assert chat.render_incrementally([("user", "x")] * 400, late).rewrites == 300
    turns = [("user" if i % 2 == 0 else "assistant", f"turn {i} </s>") for i in range(200)]
    assert chat.render_turns(turns, chat.instruct_template) == chat.render_incrementally(turns, chat.instruct_template)
    numbered = lambda ts: "".join(f"{i}{r}{t}" for i, (r, t) in enumerate(ts))
    assert chat.render_incrementally(turns, numbered).rewrites is None


def test_declared_templates_take_no_square_time_and_are_held_to_their_word():
    assert len(chat.render_turns([("user", "x" * 50)] * 100_000, chat.instruct_template).spans) == 100_000
    with pytest.raises(ValueError):
        chat.render_turns([("user", "a"), ("user", "b")], lambda ts: "".join(f"{i}{t}" for i, (_, t) in enumerate(ts)))


def test_declared_templates_give_the_same_rows(spark):
    frame = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], f"t{i} [INST]") for i in range(100)] + [(2, 0, "tool", None)], "conv_id long, turn long, role string, text string")
    assert sorted(map(str, chat.format_chats(frame, turnwise=True).collect())) == sorted(map(str, chat.format_chats(frame).collect()))
