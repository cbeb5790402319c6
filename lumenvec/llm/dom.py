"""A page's document tree, read leniently as browsers do: unclosed and stray tags, implied ends, raw text, broken ends.

Every step is constant in the depth of the tree (amortised), so a page takes time in proportion to its length.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

#: A tag; quotes count only where an attribute's value begins. A tag that never ends doesn't match.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?=[^"'\s]|$)))*+)>""")
_ATTRIBUTES = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text isn't parsed, and those that show none of their text in the page.
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = RAW | frozenset("head noscript template select datalist button svg math object audio video canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that end an open paragraph when they begin.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt listing".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a search for an open one doesn't leave.
_SCOPE = frozenset("table td th caption template button object marquee html".split())
_IN_HEAD = frozenset("base link meta title style script noscript template".split())


@dataclass
class Page:
    """Nodes in page order: elements, and text under them. ``pieces`` are all texts, white space too, by block."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    pieces: list[tuple[int, int, str]] = field(default_factory=list)  # block, node (-1: white space), text


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTES.finditer(raw)}


class _Builder:
    def __init__(self):
        self.page = Page()
        self.stack: list[tuple[str, int]] = []
        self.open: dict[str, list[int]] = defaultdict(list)  # by tag, the places in the stack
        self.scope: list[int] = []
        self.boxes: list[int] = []  # no inline element, and neither div, p nor address: an li doesn't end beyond
        self.blocks: list[int] = []  # no inline element
        self.block = 0
        self.unseen = 0
        self._push("html", "")

    def _push(self, tag: str, raw: str) -> None:
        p, k = self.page, len(self.stack)
        p.parent.append(self.stack[-1][1] if k else -1)
        p.tag.append(tag)
        p.attributes.append(raw)
        p.text.append("")
        self.stack.append((tag, len(p.tag) - 1))
        self.open[tag].append(k)
        if tag in _SCOPE:
            self.scope.append(k)
        if tag not in INLINE:
            self.block += 1
            self.blocks.append(k)
            if tag not in ("div", "p", "address"):
                self.boxes.append(k)
        self.unseen += tag in UNSEEN

    def _pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            tag, _ = self.stack.pop()
            self.open[tag].pop()
            for held in (self.scope, self.boxes, self.blocks):
                if held and held[-1] == len(self.stack):
                    held.pop()
            if tag not in INLINE:
                self.block += 1
            self.unseen -= tag in UNSEEN

    def _last(self, *tags: str) -> int:
        return max((self.open[t][-1] for t in tags if self.open[t]), default=-1)

    def _close(self, tags: tuple[str, ...], within: list[int]) -> None:
        """Ends the innermost open element of these tags, unless an element of ``within`` lies between."""
        k = self._last(*tags)
        if k > 0 and k >= (within[-1] if within else 0):
            self._pop_to(k)

    def start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self.words(" ")
            return
        if tag in ("html", "body"):
            self._close(("head",), self.scope)
            if tag == "body" and not self.open["body"]:
                self._push("body", raw)
            return
        if self.open["head"] and tag not in _IN_HEAD:
            self._pop_to(self.open["head"][-1])
        if tag in _ENDS_P:
            self._close(("p",), [max(self.scope[-1] if self.scope else 0, self._last("button"))])
        if tag in _HEADINGS and self.stack[-1][0] in _HEADINGS:
            self._pop_to(len(self.stack) - 1)
        elif tag == "li":
            self._close_item(("li",))
        elif tag in ("dt", "dd"):
            self._close_item(("dt", "dd"))
        elif tag in ("option", "optgroup"):
            self._close(("option",), self.open["select"])
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot") and self.open["table"]:
            lower = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(tag, ("tbody", "thead", "tfoot", "tr"))
            k = min((self.open[t][-1] for t in lower if self.open[t] and self.open[t][-1] > self.open["table"][-1]), default=-1)
            if k > 0:
                self._pop_to(k)
        elif tag == "a" and self.open["a"]:
            self._close(("a",), self.blocks)
        if tag in VOID:
            self.block += tag == "hr"
            return
        self._push(tag, raw)

    def _close_item(self, tags: tuple[str, ...]) -> None:
        k = self._last(*tags)
        above = self.boxes[-1] if self.boxes else 0
        if k > 0 and k >= above:
            self._pop_to(k)
        self._close(("p",), self.scope)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.words(" ")
        elif tag in _HEADINGS:
            self._close(tuple(_HEADINGS), self.scope)
        elif tag in INLINE:
            self._close((tag,), self.blocks)
        elif tag not in ("html", "body") and tag not in VOID:
            # a cell's or table's own end reaches itself; others stay inside the cell
            if tag in _SCOPE or tag in ("tr", "tbody", "thead", "tfoot"):
                k, table = self._last(tag), self._last("table")
                if k > 0 and k >= table:
                    self._pop_to(k)
            else:
                self._close((tag,), self.scope)

    def words(self, raw: str) -> None:
        if self.unseen:
            if not (self.open["head"] and self.stack[-1][0] == "head") or raw.isspace() or not raw:
                return
            self._pop_to(self.open["head"][-1])  # text ends the head
        text = html.unescape(raw) if "&" in raw else raw
        if not text:
            return
        if text.isspace():
            self.page.pieces.append((self.block, -1, text))
            return
        p = self.page
        p.parent.append(self.stack[-1][1])
        p.tag.append("#text")
        p.attributes.append("")
        p.text.append(text)
        p.pieces.append((self.block, len(p.tag) - 1, text))


_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def parse(source: str) -> Page:
    b, begin, at, n = _Builder(), 0, 0, len(source)
    while True:
        i = source.find("<", at)
        if i < 0:
            break
        m = _TAG.match(source, i)
        if m is None:
            c = source[i + 1 : i + 2]
            if source.startswith("<!--", i):
                stop = i + 5 if source.startswith("<!-->", i) else source.find("-->", i + 4) + 3
                stop = stop if stop > i + 4 else n + 1
            elif c in ("!", "?") or (c == "/" and i + 2 < n):
                stop = source.find(">", i) + 1 or n + 1
            elif c.isascii() and c.isalpha():  # a tag that the page's end cuts off
                stop = n + 1
            else:
                at = i + 1
                continue
            b.words(source[begin:i])
            begin = at = min(stop, n)
            continue
        if i > begin:
            b.words(source[begin:i])
        begin = at = m.end()
        tag = m[2].lower()
        if m[1]:
            b.end(tag)
            continue
        b.start(tag, m[3])
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            begin = at = end.start() if end else n
    b.words(source[begin:])
    return b.page


def joined(pieces: list[tuple[int, int, str]], keep) -> str:
    """The kept texts by block: white space turned into one space, trimmed, a line a block."""
    out, now, held = [], -1, []
    for block, node, text in pieces:
        if block != now:
            out.append(" ".join("".join(held).split()))
            now, held = block, []
        if node < 0 or keep[node]:
            held.append(text)
    out.append(" ".join("".join(held).split()))
    return "\n".join(x for x in out if x)
