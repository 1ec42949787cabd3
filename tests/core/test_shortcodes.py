"""The tokenizer against a character-by-character version, in every form of quote, and fixed cases of the tree."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.functions import shortcodes as S

QUOTES = ("&quot;", "&#34;", "&#034;")


def entity(text, i):
    return next((len(q) for q in QUOTES if text.startswith(q, i)), 0)


def plain_spans(text):
    """Walks the text: names, then a scan to the closing bracket that honours quotes."""
    out, i = [], 0
    while True:
        i = min((k for k in (text.find("[et_pb_", i), text.find("[/et_pb_", i)) if k >= 0), default=-1)
        if i < 0:
            return out
        closing = text[i + 1] == "/"
        k = i + 1 + closing
        end_name = k + 6
        while end_name < len(text) and text[end_name] in "abcdefghijklmnopqrstuvwxyz0123456789_":
            end_name += 1
        if end_name == k + 6 or end_name == len(text) or text[end_name] not in "]/ \t\n\r\f\v":
            i = end_name
            continue
        quote, at, end = "", end_name, None
        while at < len(text):
            n = entity(text, at)
            if quote == "e":
                if n or text[at] == '"':
                    quote = ""
            elif quote:
                if not n and text[at] == quote:
                    quote = ""
            elif n:
                quote = "e"
            elif text[at] in "\"'":
                quote = text[at]
            elif text[at] == "]":
                end = at
                break
            elif text[at] == "[":
                break
            at += n or 1
        if end is None:
            i = end_name
            continue
        body = text[end_name:end].rstrip(S.BLANKS)
        slash = body.endswith("/")
        out.append(S.Span(text[k:end_name], i, end + 1, (body[:-1] if slash else body).strip(S.BLANKS), closing, slash and not closing))
        i = end + 1


PARTS = ["[et_pb_text", "[/et_pb_text", "[et_pb_row", "[et_pb_row-x", "]", "/]", "[", '"', "'", "&quot;", "&#34;", "&#034;", "&amp;", " ", "\n", " a=", " b =", "x", "/", "é", "="]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_spans_are_those_of_a_plain_walk(text):
    assert S.tag_spans(text) == plain_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["[et_pb_row]", "[/et_pb_row]", "[et_pb_text]", "[/et_pb_text]", "[et_pb_text /]", "t", " "]), max_size=20).map("".join))
def test_the_tree_keeps_all_text_and_its_order(text):
    nodes = S.nodes(text)
    assert [n.node_id for n in nodes] == list(range(len(nodes)))
    for n in nodes:
        assert n.last_id >= n.node_id and (n.parent_id is None or nodes[n.parent_id].node_id < n.node_id <= nodes[n.parent_id].last_id)
    words = "".join(S.strip_tags(n.content) for n in nodes if n.tag == S.TEXT)
    assert words.replace(" ", "") == S.strip_tags(text).replace(" ", "")


@pytest.mark.parametrize("quote", ['"{}"', "'{}'", "&quot;{}&quot;", "&#34;{}&#34;", "&#034;{}&#034;", "&#8220;{}&#8221;", '&quot;{}"'])
def test_every_form_of_quote(quote):
    tag = f"[et_pb_text title={quote.format('a b')} x={quote.format('')}]body[/et_pb_text]"
    (node, text) = S.nodes(tag)
    assert node.attrs == [("title", "a b"), ("x", "")] and text.content == "body" and node.last_id == 1


@pytest.mark.parametrize(
    "text,want",
    [
        ('a="1" a="2" a=\'3\'', [("a", "2")]),
        ("a='1' a='2' a=\"3\"", [("a", "3")]),
        ("a=1 b=\"x", [("b", "x")]),
        ("k-e_y = 'v'", [("k-e_y", "v")]),
        ("", []),
    ],
)
def test_attributes(text, want):
    assert S.attributes(text) == want


def test_depth_is_bounded_and_text_is_kept():
    deep = "".join(f"[et_pb_row a=\"{i}\"]" if False else f"[et_pb_m{i}]" for i in range(50)) + "core" + "".join(f"[/et_pb_m{i}]" for i in reversed(range(50)))
    nodes = S.nodes(deep)
    assert max(n.depth for n in nodes) == S.MAX_DEPTH + 1 and nodes[-1].content == "core"


def test_orphans_and_unclosed():
    kinds = lambda t: [(n.tag.removeprefix("et_pb_"), n.depth, n.content) for n in S.nodes(t)]
    assert kinds("x[/et_pb_row]y") == [(S.TEXT, 0, "x[/et_pb_row]y")]
    assert kinds("[et_pb_row]a[et_pb_text]b") == [("row", 0, "a[et_pb_text]b"), (S.TEXT, 1, "a"), ("text", 1, "b"), (S.TEXT, 2, "b")]
    assert kinds("[et_pb_a][et_pb_b][/et_pb_a][/et_pb_b]z") == [("a", 0, "[et_pb_b]"), ("b", 1, ""), (S.TEXT, 0, "[/et_pb_b]z")]
    assert S.nodes("a\r\nb\rc")[0].content == "a\nb\nc"
