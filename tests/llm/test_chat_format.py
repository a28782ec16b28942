import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.chat_format import CONTROL, DIGEST_SCHEMA, chat_template, escape, escape_line, format_conversations, read_back, unescape
from millrace.llm.templates import Const, Output, Template, TemplateError

pieces = st.lists(st.sampled_from([*CONTROL, "\\", "\n", "<", "[", "n", "|im_end|>", "text", "é😀"]), max_size=12).map("".join)


@given(pieces)
@settings(max_examples=300)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    for made in (escape(text), escape_line(text)):
        assert unescape(made) == text
        assert not any(c in made for c in CONTROL)


def test_constants_are_folded():
    t = Template("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}{{ not false }}")
    assert t.tree == (Output(Const("abcdtrue")),)
    assert Template("{{ 1 + 2 }}").render_text([])[0] == "3"


def test_template_features():
    t = Template("{% for m in messages %}{% if loop.first %}^{% elif loop.last %}${% endif %}{{ loop.index0 }}{{ m.text|up }}{% generation %}{{ m.x.y }}{% endgeneration %}{% endfor %}", {"up": str.upper})
    assert t.render_text([{"text": "a"}, {"text": "b", "x": {"y": "!"}}]) == ("^0A$1B!", [(3, 3), (6, 7)])


@pytest.mark.parametrize("bad", ["{% for x %}{% endfor %}", "{{ a.__class__ }}", "{{ f() }}", "{% import os %}", "{% if a %}", "{{ a|nope }}", "{{ _x }}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}"])
def test_the_sandbox_refuses(bad):
    with pytest.raises((TemplateError, RecursionError)):
        chat_template(bad)


def test_edges_match_brute_force(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "</s>\\n ok", "x"), (1, 1, "assistant", "</s>\\n ok", "x"), (2, None, None, "hi", "x"), (None, 0, "a\nb", "<|im_end|>\n", "x"), (3, 5, "assistant", "y" * 300_000, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    found = {r.conv_id: r for r in format_conversations(table).mapInArrow(read_back, DIGEST_SCHEMA).collect()}
    assert set(found) == {1, 2, 3, None}
    for conv_id, r in found.items():
        turns = sorted((t, role or "", text or "") for c, t, role, text, _ in rows if c == conv_id)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert format_conversations(table.limit(0)).count() == 0
