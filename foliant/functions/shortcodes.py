"""The shortcode tokenizer: the one part of the engine that reads a document character by character.

Tags are `[name attr="value" ...]`, `[/name]` and `[name ... /]`. A quoted value is opaque, brackets included; a value that
an encoded quote opens is closed by an encoded quote or a literal one; an unquoted `[` makes what came before it text.
One pass of one pattern finds all tags; the tree is then built over their positions.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Levels of nesting beyond which tags are stripped and their text is kept.
MAX_DEPTH = 32
TEXT = "__text__"
COLUMN_TAGS = ("et_pb_column", "et_pb_column_inner")
MAP_TAGS = ("et_pb_map", "et_pb_fullwidth_map")
BLANKS = " \t\n\r\0\x0b"
_QUOTE = "&(?:quot|#0?34);"
_TAG = re.compile(
    rf"""(?a)\[(?P<closing>/?)(?P<tag>et_pb_[a-z0-9_]++)(?=[\]/\s])
    (?P<body>(?:[^\]\["'&] | &(?!(?:quot|\#0?34);) | "[^"]*" | '[^']*' | {_QUOTE.replace("#", chr(92) + "#")}(?:(?!{_QUOTE.replace("#", chr(92) + "#")})[^"])*(?:{_QUOTE.replace("#", chr(92) + "#")}|"))*+)\]""",
    re.X,
)
_ATTRIBUTE = re.compile(rf"""(?a)([\w-]+)\s*=\s*(?:{_QUOTE}((?:(?!{_QUOTE})[^"])*)(?:{_QUOTE}|"|\Z)|"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z))""")
_CURLY_DOUBLE, _CURLY_SINGLE = re.compile("&#(?:8220|8221|8243);"), re.compile("&#(?:8216|8217);")


class Span(NamedTuple):
    tag: str
    start: int
    end: int
    attrs_str: str
    closing: bool
    self_closing: bool


class Node(NamedTuple):
    """One row of a document's tree, in document order. parent_id is None at the top; ordinal counts siblings from 0;
    last_id is the last node of the subtree, the node itself if it has no children. own_text is a module's content without
    its modules: all of it if it has none, else its own text parts, joined by line feeds. columns counts the children that a
    parent is drawn from: a row's columns, a map's pins with a title, a form's fields."""

    node_id: int
    parent_id: int | None
    ordinal: int
    depth: int
    tag: str
    attrs: list[tuple[str, str]]
    content: str
    last_id: int
    own_text: str
    columns: int
    parent_tag: str | None


def _drawn(parent: str, child: Node) -> bool:
    if child.tag in COLUMN_TAGS:
        return True
    if parent in MAP_TAGS:
        return child.tag == "et_pb_map_pin" and dict(child.attrs).get("title", "") not in ("", "0")
    return parent == "et_pb_contact_form" and child.tag == "et_pb_contact_field"


def tag_spans(content: str) -> list[Span]:
    spans = []
    for m in _TAG.finditer(content):
        body = m["body"].rstrip(BLANKS)
        slash = body.endswith("/")
        spans.append(Span(m["tag"], m.start(), m.end(), body.removesuffix("/").strip(BLANKS), bool(m["closing"]), slash and not m["closing"]))
    return spans


def attributes(text: str) -> list[tuple[str, str]]:
    """Names and values in the order of first mention; a later double-quoted value replaces an earlier one, a single-quoted
    one never does. Unquoted values are passed over; an unterminated one runs to the end."""
    found: dict[str, str] = {}
    for name, encoded, double, single in (m.groups() for m in _ATTRIBUTE.finditer(_CURLY_SINGLE.sub("'", _CURLY_DOUBLE.sub('"', text)))):
        if single is None:
            found[name] = double if encoded is None else encoded
        else:
            found.setdefault(name, single)
    return list(found.items())


def strip_tags(content: str) -> str:
    return _TAG.sub("", content)


def nodes(content: str) -> list[Node]:
    """The tree of a document. Text between tags is a node if it isn't blank; closers without an opener are text; an opener
    without a closer takes the rest of its parent."""
    content = content.replace("\r\n", "\n").replace("\r", "\n")
    spans = tag_spans(content)
    out: list[Node] = []

    def closer(k: int, hi: int) -> int | None:
        """The span that closes span k before position hi; only tags of its own name count."""
        depth = 1
        for j in range(k + 1, len(spans)):
            s = spans[j]
            if s.end > hi:
                return None
            if s.tag == spans[k].tag:
                depth += -1 if s.closing else not s.self_closing
                if not depth:
                    return j
        return None

    def add(parent: int | None, ordinal: int, depth: int, tag: str, attrs, text: str) -> int:
        out.append(Node(len(out), parent, ordinal, depth, tag, attrs, text, len(out), text.strip(BLANKS), 0, None if parent is None else out[parent].tag))
        return len(out) - 1

    def settle(me: int) -> None:
        """What a module learns from its children."""
        children = [n for n in out[me + 1 :] if n.parent_id == me]
        modules = [n.tag for n in children if n.tag != TEXT]
        own = "\n".join(n.content for n in children if n.tag == TEXT) if modules else out[me].own_text
        out[me] = out[me]._replace(last_id=len(out) - 1, own_text=own, columns=sum(_drawn(out[me].tag, n) for n in children))

    def walk(lo: int, hi: int, k: int, parent: int | None, depth: int) -> int:
        """Adds the nodes of content[lo:hi], whose first span is k or later; returns how many there are at this level."""
        n = 0
        if depth > MAX_DEPTH:
            if text := strip_tags(content[lo:hi]).strip(BLANKS):
                add(parent, 0, depth, TEXT, [], text)
                n = 1
            return n
        at = lo
        while True:
            while k < len(spans) and (spans[k].closing or spans[k].start < at):
                k += 1
            s = spans[k] if k < len(spans) and spans[k].end <= hi else None
            if text := content[at : s.start if s else hi].strip(BLANKS):
                add(parent, n, depth, TEXT, [], text)
                n += 1
            if not s:
                return n
            j = None if s.self_closing else closer(k, hi)
            end = s.end if s.self_closing else spans[j].start if j is not None else hi
            me = add(parent, n, depth, s.tag, attributes(s.attrs_str), content[s.end : end])
            n += 1
            if not s.self_closing and walk(s.end, end, k + 1, me, depth + 1):
                settle(me)
            if not s.self_closing and j is None:
                return n
            at = spans[j].end if j is not None else s.end
            k = (j if j is not None else k) + 1

    walk(0, len(content), 0, None, 0)
    return out
