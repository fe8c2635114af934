import pytest
from hypothesis import given
from hypothesis import strategies as st
from imgframe.llm import chat_template
from imgframe.llm.chat_template import CONTROL_STRINGS, TemplateError, conversation_digests, escape, fold, format_conversations, parse, read_turns, render, unescape

NASTY = st.lists(st.sampled_from([*CONTROL_STRINGS, "\\", "<", "|", ">", "[", "s>", "<|", "end", "é", "\n", ""])).map("".join)


@given(NASTY)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = escape(text)
    assert unescape(escaped) == text
    assert not any(c in escaped for c in CONTROL_STRINGS)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("a {{ 1 + 2 * 3 }} b", "a 7 b"),
        ("{% for m in ms %}{{ loop.index }}{{ m.a }}{% if not loop.last %},{% endif %}{% endfor %}", "1x,2y,3"),
        ("{% if ms[0].a == 'x' and 1 < 2 %}yes{% elif true %}no{% else %}never{% endif %}", "yes"),
        ("{% set z = ms | length %}{{ z ~ '!' }}", "3!"),
        ("  {%- if false -%} gone {%- else -%} kept {%- endif -%}  ", "kept"),
        ("{# remark #}{{ none }}{{ missing.field.deep }}", ""),
        ("{{ ['a', 'b'] | join('-') | upper }}", "A-B"),
        ("{{ 'it\\'s' }}{{ \"\\n\" }}", "it's\n"),
        ("{{ 'x' in ['x'] }} {{ not (1 == 2) }} {{ -3 }}", "true true -3"),
    ],
)
def test_language(source, text):
    assert render(source, ms=[{"a": "x"}, {"a": "y"}, {}])[0] == text


def test_generation_spans():
    text, spans = render("q{% generation %}a{{ x }}{% endgeneration %}z", x="bc")
    assert [text[a:b] for a, b in spans] == ["a", "bc"]


def test_constants_are_folded():
    assert fold(parse("a{{ 1 + 1 }}{% if 1 > 2 %}b{% else %}c{{ 'd' | upper }}{% endif %}")) == ("block", ("text", "a2cD"))


@pytest.mark.parametrize("source", ["{% for x %}{% endfor %}", "{% if 1 %}", "{{ }}", "{{ 1 + }}", "{{ x | exec }}", "{{ x.__class__() }}", "{% import os %}", "{{ a b }}", "{{ ` }}"])
def test_errors(source):
    with pytest.raises(TemplateError):
        parse(source)


def test_sandbox():
    """Only mappings have fields; other objects none at all."""
    for x in (object(), ["a"], "text", 1):
        with pytest.raises(TemplateError):
            render("{{ x.__class__ }}", x=x)


@pytest.mark.parametrize("source", ["{{ 1 / 0 }}", "{{ 1 % 0 }}", "{{ 'ab' * 1000 }}", "{{ '%9s' % 'x' }}", "{{ 3 * ['a'] }}", "{{ 1 < 'a' }}", "{{ -'a' }}", "{{ 99999999999 * 99999999999 }}"])
def test_arithmetic_is_of_numbers(source):
    """Whether it is folded or worked out for each conversation."""
    with pytest.raises(TemplateError):
        render(source)
    with pytest.raises(TemplateError):
        render("{{ x * 1000 }}{{ y % 'x' }}", x="ab", y="%99s")
    with pytest.raises(TemplateError):
        render("{{ 1 / x }}", x=0)
    assert render("{{ 7 % 4 * 2 - 1 }} {{ x / 4 }}", x=2)[0] == "5 0.5"


@pytest.mark.parametrize("part", [1 << 20, 1, 40])
def test_round_trip_in_parts(spark, monkeypatch, part):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a\\<|end|>"), (1, 0, "user", "a\\<|end|>"), (None, None, None, None), (2, 5, "assistant", None), (3, 1, "assistant", "</s>[INST]\\"), (3, 2, "assistant", "<|turn|>x")]
    monkeypatch.setattr(chat_template, "PART_CHARS", part)
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, formatted string")
    formatted = format_conversations(frame)
    turns = sorted((r.conv_id if r.conv_id is not None else -1, r.place, r.role, r.text) for r in read_turns(formatted).collect())
    assert turns == [(-1, 0, "", ""), (1, 0, "user", "a\\<|end|>"), (1, 1, "user", "a\\<|end|>"), (1, 2, "assistant", "b"), (2, 0, "assistant", ""), (3, 0, "assistant", "</s>[INST]\\"), (3, 1, "assistant", "<|turn|>x")]
    loss = {r.conv_id: r.loss_chars for r in conversation_digests(formatted).collect()}
    assert loss == {None: 0, 1: 1, 2: 0, 3: len("</s>[INST]\\<|turn|>x")}


def test_no_rows(spark):
    assert conversation_digests(format_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).count() == 0
