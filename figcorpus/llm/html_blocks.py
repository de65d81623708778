"""Leaf blocks of a page's DOM: their text, tag path and link share."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements that end a block where they open or close; all others run inside one.
BLOCK_TAGS = frozenset(
    "html head body header footer nav aside main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot "
    "tr td th caption form fieldset legend figure figcaption blockquote pre address details summary dialog menu button select option "
    "optgroup label center hgroup search".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no page text; it ends at their own closing tag.
RAW_TAGS = frozenset("script style title textarea iframe noscript noembed noframes xmp template svg object canvas".split())
#: An opening tag closes these, up to the element that holds them.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """``path``: tags of the enclosing elements, outermost first; ``marks``: words of their class, id and role."""

    text: str
    path: tuple[str, ...]
    marks: frozenset[str]
    link_share: float
    opener: int = 0
    own_marks: frozenset[str] = field(default_factory=frozenset)


def _marks(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        found.update(t.lower() for t in _TOKEN.findall(m[2] or m[3] or m[4] or ""))
    return frozenset(found)


def blocks(page: str | None) -> list[Block]:
    """Blocks in page order, without those that have no text.

    Character references are decoded and white space becomes one space. Elements
    that stay open, and whatever a cut page lacks, end with the page; closing
    tags that open nothing are passed over.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], int]] = [("", frozenset(), 0)]
    parts: list[str] = []
    linked, links, serial = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                whole = max(1, sum(map(len, parts)))
                marks = frozenset().union(*[m for _, m, _ in stack])
                out.append(Block(text, tuple(t for t, _, _ in stack[1:]), marks, min(1.0, linked / whole), stack[-1][2], stack[-1][1]))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    at, page = 0, page or ""
    while True:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW_TAGS:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br" or name == "hr":
            parts.append(" ")
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        if name not in BLOCK_TAGS or name in VOID_TAGS:
            if name not in VOID_TAGS and m[3].endswith("/"):
                pass
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            links = 0 if name != "li" and links else links
            if stack[-1][0] == "p":
                stack.pop()
            if name in _CLOSES:
                shut, bounds = _CLOSES[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in bounds:
                        break
                    if stack[i][0] in shut:
                        del stack[i:]
                        break
            serial += 1
            stack.append((name, _marks(m[3]), serial))
    flush()
    return out
