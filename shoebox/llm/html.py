"""A small, forgiving reader of HTML: one pass over the page, a flat list of elements."""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

_MARK = re.compile(
    r"""<!--.*?(?:-->|\Z)          # comments
      | <!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)
      | <[!?][^>]*>?               # declarations
      | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | <(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
# An element that is open is closed by the start of one of these.
CLOSED_BY = {
    "p": set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
    "head": {"body"},
}
# Elements inside which an open element of a kind is not reached by these closings.
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}


@dataclass
class Element:
    tag: str
    parent: int
    names: frozenset[str] = frozenset()  # words of class and id
    role: str = ""
    hidden: bool = False
    parts: list = field(default_factory=list)  # texts, and numbers of children, in order


def _described(raw: str) -> tuple[frozenset[str], str, bool]:
    names, role, hidden = set(), "", False
    for match in _ATTR.finditer(raw):
        key = match[1].lower()
        value = html.unescape(match[2] or match[3] or match[4] or "")
        if key in ("class", "id"):
            names.update(w.lower() for w in _WORD.findall(value))
        elif key == "role":
            role = value.strip().lower()
        elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true":
            hidden = True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return frozenset(names), role, hidden


def parse(page: str) -> list[Element]:
    """Elements in page order; the first is the page itself. Texts have their character references decoded."""
    elements = [Element("", -1)]
    stack = [0]
    place = 0

    def text(raw: str) -> None:
        if raw:
            elements[stack[-1]].parts.append(html.unescape(raw))

    while True:
        match = _MARK.search(page, place)
        if not match:
            text(page[place:])
            return elements
        text(page[place : match.start()])
        place = match.end()
        if match["cdata"] is not None:
            elements[stack[-1]].parts.append(match["cdata"])
            continue
        tag = (match["tag"] or match["tag2"] or "").lower()
        if not tag:
            continue
        if match["end"] or match["end2"]:
            for depth in range(len(stack) - 1, 0, -1):
                if elements[stack[depth]].tag == tag:
                    del stack[depth:]
                    break
                if elements[stack[depth]].tag in ("table", "article", "main", "body") and tag in INLINE | {"p", "li"}:
                    break
            continue
        depth = len(stack) - 1
        while depth > 0:
            kind = elements[stack[depth]].tag
            if tag in CLOSED_BY.get(kind, ()):
                del stack[depth:]
            elif kind not in INLINE and kind not in CLOSED_BY or kind in _FENCE.get(tag, ()):
                break
            depth -= 1
        raw = match["attrs"] if match["tag"] else match["attrs2"]
        element = Element(tag, stack[-1], *_described(raw)) if "=" in raw or "hidden" in raw else Element(tag, stack[-1])
        elements[stack[-1]].parts.append(len(elements))
        elements.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, place)
            if tag in ("textarea", "title"):
                element.parts.append(html.unescape(page[place : end.start() if end else len(page)]))
            place = end.end() if end else len(page)
        elif tag not in VOID and not raw.endswith("/"):
            stack.append(len(elements) - 1)
        elif tag not in VOID and tag not in ("svg", "path"):
            stack.append(len(elements) - 1)


def subtree_hashes(elements: list[Element]) -> list[int]:
    """A signed 64-bit hash of each element with all it holds; white space counts as one space."""
    digests: list[bytes] = [b""] * len(elements)
    for i in range(len(elements) - 1, -1, -1):
        e = elements[i]
        h = hashlib.blake2b(f"{e.tag} {' '.join(sorted(e.names))}".encode(), digest_size=8)
        for part in e.parts:
            h.update(digests[part] if isinstance(part, int) else b"\x00" + " ".join(part.split()).encode("utf-8", "replace"))
        digests[i] = h.digest()
    return [int.from_bytes(d, "little", signed=True) for d in digests]
