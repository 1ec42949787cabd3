"""Loose HTML cut into a flat list of blocks, for the tokenizer's pass: openers and closers where blocks nest, one row each
otherwise. Pieces are slices of the source, never re-serialised; what they look like as blocks is the renderer's business.

Elements are found in one pass over the tags with a stack of what is open, in work that grows with the text however deep or
broken it is: an opener may end what can't hold it (ENDS), a closer ends what is open inside its element, and one that
would have to leave an element of a higher rank (RANKS) or has no opener is passed over; what is still open takes the rest.

Kinds: p, h (level), hr, pre, table, html (verbatim), embed (an iframe, embed, object or video element), list and /list
(level 1: ordered), item, nest (a list follows inside the item) and /item, quote and /quote (its citation), and notes of
what was lost: delimiter, table_attribute, table_child (its name).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

BLANKS = " \t\n\r\0\x0b"
#: Elements that stand in a paragraph, that have no content, that are seen through, and that hold no tags.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em i img ins kbd label mark q rp rt ruby s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNWRAPPED = ("div", "section", "article")
RAW = ("script", "style")
LISTS = ("ul", "ol")
_GROUPS, _CELLS = ("thead", "tbody", "tfoot"), ("td", "th")
#: (openers, the open elements that they end, the elements beyond which they end none). Besides, whatever isn't inline ends a p.
ENDS = ((("li",), ("li",), LISTS), (("dt", "dd"), ("dt", "dd"), ("dl",)), (_CELLS, _CELLS, ("table",)), (("tr",), ("tr", *_CELLS), ("table",)), (_GROUPS, (*_GROUPS, "tr", *_CELLS), ("table",)), (("option",), ("option",), ("select",)))
_ENDED = {name: (ended, walls) for names, ended, walls in ENDS for name in names}
#: A closer leaves no open element of a higher rank than its own; 100 where none is named (fixed values).
RANKS = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}
MAX_DEPTH = 10
#: Added to the level of a p or h that the module's settings don't style: those in a quote.
PLAIN = 10
_START, _MARK = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9-]*))"), re.compile("[\"'>]")
_RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}
_OPEN_MEDIA, _CLOSE_MEDIA = re.compile(r"<(?:iframe|embed|object|video)\b", re.I), re.compile(r"</(?:iframe|embed|object|video)>", re.I)
_MARKUP, _HAS_MEDIA = re.compile(r"<[a-zA-Z!/]"), re.compile(r"<(?:iframe|embed|object|video)[\s>]", re.I)
_SHOWS_NOTHING = re.compile(r"<(?!img\b|br\b)[^>]*>", re.I)

Block = tuple[str, int, str]


class Element:
    """A part of the source: an element, text (name '') or a comment ('!', its content in attrs). inner and stop are where
    its content begins and ends; number and last are its own and its last descendant's place among all parts."""

    __slots__ = ("attrs", "children", "end", "inner", "last", "name", "number", "shows", "start", "stop")

    def __init__(self, name: str, attrs: str, start: int, inner: int, end: int, number: int):
        self.name, self.attrs, self.start, self.inner, self.stop, self.end = name, attrs, start, inner, end, end
        self.number = self.last = number
        self.children: list[Element] = []
        self.shows = False


def _tag_ends(html: str) -> tuple[list[int], list[int]]:
    """(places of quotes and closing brackets; for each the bracket that ends a tag which is outside of quotes there, or -1)."""
    at = [m.start() for m in _MARK.finditer(html)]
    ends, after = [-1] * (len(at) + 1), {}
    for k in range(len(at) - 1, -1, -1):
        mark = html[at[k]]
        if mark == ">":
            ends[k] = at[k]
        else:
            ends[k] = ends[after[mark] + 1] if mark in after else -1
            after[mark] = k
    return at, ends


def tokens(html: str) -> Iterator[tuple[str, bool, str, int, int]]:
    """(name, whether it closes, attributes, start, end) of each tag, and of each comment with the name '!'. In a RAW element
    only its closer is a tag."""
    at, ends = _tag_ends(html)
    last_comment, place = html.rfind("-->"), 0
    while m := _START.search(html, place):
        place = m.end()
        if m[2] is None:
            if place <= last_comment:
                stop = html.index("-->", place)
                yield "!", False, html[place:stop], m.start(), stop + 3
                place = stop + 3
            continue
        end = ends[bisect_left(at, place)]
        if end < 0:
            continue
        name = m[2].lower()
        yield name, bool(m[1]), html[place:end], m.start(), end + 1
        place = end + 1
        if name in RAW and not m[1]:
            closer = _RAW_END[name].search(html, place)
            place = closer.start() if closer else len(html)


def parse(html: str) -> list[Element]:
    """All parts in document order, the first of them the whole."""
    parts = [Element("", "", 0, 0, len(html), 0)]
    stack = [parts[0]]
    opened: dict[str, list[int]] = {}  # places in the stack, by name
    blocks: list[int] = []  # and of what isn't inline

    def add(name: str, attrs: str, start: int, inner: int, end: int) -> Element:
        parts.append(Element(name, attrs, start, inner, end, len(parts)))
        stack[-1].children.append(parts[-1])
        return parts[-1]

    def leave(depth: int, stop: int, end: int) -> None:
        """Ends the element at this place of the stack, and all that is open in it where its content stops."""
        while len(stack) > depth:
            part = stack.pop()
            part.stop, part.end, part.last = stop, end if len(stack) == depth else stop, len(parts) - 1
            opened[part.name].pop()
            if part.name not in INLINE:
                blocks.pop()

    def innermost(names: Iterable[str]) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=0)

    at = 0
    for name, closes, attrs, start, end in tokens(html):
        if start > at:
            add("", "", at, at, start)
        at = end
        if name == "!":
            add("!", attrs, start, start, end)
        elif closes:
            depth = innermost((name,))
            higher = innermost(n for n, rank in RANKS.items() if rank > RANKS.get(name, 100))
            if depth > max(higher, innermost(_ENDED[name][1]) if name in _ENDED else 0):
                leave(depth, start, end)
        else:
            if name not in INLINE and blocks and stack[blocks[-1]].name == "p":
                leave(blocks[-1], start, start)
            if name in _ENDED:
                ended, walls = _ENDED[name]
                wall = innermost(walls)
                if inside := [opened[n][-1] for n in ended if opened.get(n) and opened[n][-1] > wall]:
                    leave(min(inside), start, start)
            part = add(name, attrs, start, end, end)
            if name not in VOID:
                opened.setdefault(name, []).append(len(stack))
                if name not in INLINE:
                    blocks.append(len(stack))
                stack.append(part)
    if at < len(html):
        add("", "", at, at, len(html))
    leave(1, len(html), len(html))
    for part in reversed(parts):
        part.shows = part.name in LISTS and any(c.name == "li" or c.shows for c in part.children)
    return parts


def media_parts(html: str) -> Iterator[tuple[bool, str]]:
    """(whether it is media, part): media elements, from an opener to the next closer of any of them, and what lies between.
    One that closes itself and has no closer after it is media as well."""
    closers = [m.span() for m in _CLOSE_MEDIA.finditer(html)]
    starts, at, bracket = [a for a, _ in closers], 0, -1
    for m in _OPEN_MEDIA.finditer(html):
        if m.start() < at:
            continue
        if bracket < m.end():
            bracket = html.find(">", m.end())
            if bracket < 0:
                break
        k = bisect_left(starts, bracket + 1)
        end = closers[k][1] if k < len(closers) else bracket + 1 if html[bracket - 1] == "/" else None
        if end is not None:
            yield False, html[at : m.start()]
            yield True, html[m.start() : end]
            at = end
    yield False, html[at:]


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    for is_media, part in media_parts(html) if _HAS_MEDIA.search(html) else ((False, html),):
        part = part.strip(BLANKS)
        if is_media:
            out.append(("embed", 0, part))
        elif part and not _MARKUP.search(part):
            out.append(("p", 0, part))
        elif part:
            parts = parse(part)
            out += _flow(part, parts, parts[0].children, 0)
    return out


def _shown(text: str) -> bool:
    """Whether text shows anything but tags; pictures and line breaks show."""
    tagged, bracket, rest = text.rpartition(">")
    return bool(rest.strip(BLANKS) or _SHOWS_NOTHING.sub("", tagged + bracket).strip(BLANKS))


def _flow(html: str, parts: list[Element], children: list[Element], depth: int) -> list[Block]:
    """Children in order: runs of text and inline elements are paragraphs, anything else is a block."""
    if depth > MAX_DEPTH:
        text = "".join(html[c.start : c.end] for c in children).strip(BLANKS)
        return [("html" if _MARKUP.search(text) else "p", 0, text)] if text else []
    out: list[Block] = []
    run: list[str] = []
    for c in [*children, None]:
        if c is not None and (c.name == "" or c.name in INLINE):
            run.append(html[c.start : c.end])
            continue
        text, run = "".join(run), []
        if _shown(text):
            out.append(("p", 0, text.strip(BLANKS)))
        if c is not None:
            out += _block(html, parts, c, depth)
    return out


def _block(html: str, parts: list[Element], c: Element, depth: int) -> list[Block]:
    name, inner, whole = c.name, html[c.inner : c.stop], html[c.start : c.end]
    if name == "!":
        return [("delimiter", 0, "")] if re.match(r"\s*/?wp:", c.attrs) else [("html", 0, whole)]
    if name == "p":
        return [("p", 0, inner.strip(BLANKS))] if _shown(inner) else []
    if re.fullmatch("h[1-6]", name):
        return [("h", int(name[1]), inner)]
    if name == "hr":
        return [("hr", 0, "")]
    if name == "pre":
        return [("pre", 0, inner)]
    if name in LISTS:
        return list(_list_rows(html, c)) if c.shows else []
    if name == "blockquote":
        body = [(k, PLAIN + v % PLAIN if k in ("p", "h") else v, h) for k, v, h in _flow(html, parts, [x for x in c.children if x.name != "cite"], depth + 1)]
        cite = next((html[x.inner : x.stop] for x in reversed(c.children) if x.name == "cite"), "")
        return [("quote", 0, ""), *body, ("/quote", 0, cite.strip(BLANKS))] if body else []
    if name == "table":
        return _table(html, parts, c)
    return _flow(html, parts, c.children, depth + 1) if name in UNWRAPPED else [("html", 0, whole)]


def _list_rows(html: str, first: Element) -> Iterator[Block]:
    """Of a list that has items. A list that stands in a list and not in an item belongs to the item before it, or to one of its
    own where there is none. Lists that are yet to come wait on a stack, so their depth doesn't matter."""
    waiting: list[Block | Element] = [first]
    while waiting:
        x = waiting.pop()
        if not isinstance(x, Element):
            yield x
            continue
        items: list[tuple[str, list[Element]]] = []
        for c in x.children:
            if c.name == "li":
                text = "".join(html[k.start : k.end] for k in c.children if k.name not in LISTS)
                items.append((text.strip(BLANKS), [k for k in c.children if k.shows]))
            elif c.shows:
                if not items:
                    items.append(("", []))
                items[-1][1].append(c)
        ordered = int(x.name == "ol")
        rows: list[Block | Element] = [("list", ordered, "")]
        for text, nested in items:
            rows += [("item", 0, text), *([("nest", 0, ""), *nested] if nested else []), ("/item", 0, "")]
        waiting += reversed([*rows, ("/list", ordered, "")])


def _table(html: str, parts: list[Element], c: Element) -> list[Block]:
    """Tables that the block can't hold stay verbatim: with attributes, with children other than rows and row groups, without
    rows. Loose rows get a body."""
    whole = html[c.start : c.end]
    if any(p.name not in ("", "!") and p.attrs.strip(BLANKS + "/") for p in parts[c.number + 1 : c.last + 1]):
        return [("table_attribute", 0, ""), ("html", 0, whole)]
    if c.attrs.strip():
        return [("html", 0, whole)]
    groups, loose = "", ""
    for x in c.children:
        if x.name in _GROUPS:
            groups += html[x.start : x.end]
        elif x.name == "tr":
            loose += html[x.start : x.end]
        elif x.name not in ("", "!"):
            return [("table_child", 0, x.name), ("html", 0, whole)]
    rows = groups + (f"<tbody>{loose}</tbody>" if loose else "")
    return [("table", 0, rows)] if rows else [("html", 0, whole)]
