"""Main text of web pages by a graphical model on the document tree.

Every element that holds text and every text is a binary variable, content or not. Unary potentials weigh its features
(kind of tag, words in class, id and role, how much text lies below, how much of it in links, punctuation, place in the page);
each child is tied to its parent by a 2 x 2 potential that depends on the kinds of the two. On a tree, sum-product message
passing, once upward and once downward, gives exact marginals; texts with a content marginal of at least one half are kept.
Potentials are trained by maximum likelihood on labelled pages: the gradient is what the labels count, less what the marginals expect.

A whole block of pages goes through numpy at once, level by level of depth; pages are independent, so nothing is shuffled.

Defined results: a null or empty page has no text; a page without markup is one block of its own; a repeated row gets its
result each time; an empty table gives an empty result; extra columns are ignored. Pages are read whole, and cut or broken
markup is read as browsers read it (``dom``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.dom import INLINE, Page, attributes, joined, parse
from lumenvec.llm.html_training import LABEL, labelled_pages
from lumenvec.llm.textscan import blocks

#: Labelled pages that a fit reads at most, and how it goes on.
FIT_PAGES, STEPS, RATE, PENALTY = 600, 160, 0.1, 0.01

_KINDS = {
    "root": "html body", "box": "div section center details summary hgroup", "article": "article", "main": "main", "nav": "nav menu dir", "header": "header", "footer": "footer", "aside": "aside",
    "form": "form fieldset legend label output", "dialog": "dialog", "table": "table tbody thead tfoot tr", "cell": "td th", "list": "ul ol dl", "item": "li dt dd", "para": "p",
    "title": "h1 h2", "heading": "h3 h4 h5 h6", "quote": "blockquote pre", "figure": "figure figcaption caption", "link": "a", "address": "address", "text": "#text", "inline": "", "other": "",
}
KINDS = list(_KINDS)
_KIND_OF = {t: k for k, tags in enumerate(_KINDS.values()) for t in tags.split()} | {t: KINDS.index("inline") for t in INLINE - {"a", "label", "output"}}
_OTHER, _TEXT, _LINK = KINDS.index("other"), KINDS.index("text"), KINDS.index("link")
#: Kinds that count as one where a pair of them chooses a potential.
_CLASSES = {"root": 0, "box": 1, "table": 1, "cell": 1, "other": 1, "article": 2, "main": 2, "nav": 3, "header": 4, "footer": 3, "aside": 3, "form": 3, "dialog": 3, "address": 3, "list": 5, "item": 5, "para": 6, "title": 7, "heading": 7, "quote": 6, "figure": 6, "link": 8, "inline": 8, "text": 9}
_CLASS_OF = np.array([_CLASSES[k] for k in KINDS])
N_CLASSES = 10

#: Words in class, id, role and itemprop that speak for or against content.
_HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs pagination pager toc tabs toolbar",
    "header": "header masthead topbar banner branding logo",
    "footer": "footer bottom copyright colophon contentinfo legal",
    "sidebar": "sidebar side aside widget widgets rail complementary secondary",
    "related": "related recommended more popular trending teaser teasers archive tags",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion affiliate outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay warning disclaimer",
    "comment": "comment comments reply replies respond discussion disqus commentlist reader",
    "form": "form login signup signin search subscribe newsletter contact",
    "share": "share sharing social follow print buttons",
    "meta": "meta byline author date dateline info details",
    "article": "article post entry story hentry blog blogpost articlebody",
    "content": "content body text main maincontent bodytext copy prose",
    "title": "title headline heading",
}
HINTS = list(_HINTS)
_HINT_OF = {w: 1 << k for k, words in enumerate(_HINTS.values()) for w in words.split()}
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NUMBERS = ("chars", "links", "stops", "texts", "mean", "share", "place", "end", "short", "mark")
#: Kinds of section; the nearest one above a node is a feature of it, and whether any of them stands above is another.
_SECTIONS = [KINDS.index(k) for k in ("article", "main", "nav", "header", "footer", "aside", "form", "dialog")]
N_FEATURES = 1 + len(KINDS) + len(HINTS) + len(_NUMBERS) + 3 + 2 * len(_SECTIONS)


@lru_cache(maxsize=4096)
def hints(raw: str) -> int:
    """The families of hints in an element's attributes, a bit each."""
    a = attributes(raw)
    words = _CAMEL.sub(" ", " ".join(a.get(k, "") for k in ("class", "id", "role", "itemprop"))).lower()
    found = 0
    for w in _PARTS.findall(words):
        found |= _HINT_OF.get(w, 0)
    return found


@dataclass
class Forest:
    """The variables of some pages: parents (-1 for roots), pairs' potentials, features, and which node each one is."""

    page: np.ndarray
    node: np.ndarray
    parent: np.ndarray
    pair: np.ndarray
    features: np.ndarray
    levels: list[np.ndarray]


def _below(values: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Sums over each node's subtree; ``values`` (nodes, numbers) are the nodes' own."""
    out = values.copy()
    for at in reversed(levels[1:]):
        _add(out, parent[at], out[at])
    return out


def _add(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Adds rows of ``values`` to the rows ``at`` of ``out``, as often as each is named; places are ascending in few steps."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out[at[first]] += np.add.reduceat(values[order], first)


def _levels(parent: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth; parents come before children."""
    depth = np.zeros(len(parent), np.int64)
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []


def forest(pages: Sequence[Page]) -> Forest:
    sizes = np.array([len(p.tag) for p in pages], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    page = np.repeat(np.arange(len(pages)), sizes)
    parent = np.concatenate([np.asarray(p.parent, np.int64) for p in pages])
    parent = np.where(parent < 0, -1, parent + base[page])
    kind = np.array([_KIND_OF.get(t, _OTHER) for p in pages for t in p.tag], np.int64)
    texts = [t for p in pages for t in p.text]
    hint = np.array([hints(a) if a and k != _LINK else 0 for a, k in zip((a for p in pages for a in p.attributes), kind.tolist(), strict=True)], np.int64)
    is_text = kind == _TEXT
    own = np.zeros((len(kind), 4))
    own[is_text] = [(len(t), t.count(".") + t.count(",") + t.count("。"), 1.0, "©" in t) for t in texts if t] or np.zeros((0, 4))
    levels = _levels(parent)
    linked = np.zeros(len(kind), bool)
    section = np.array([_SECTIONS.index(k) if k in _SECTIONS else -1 for k in range(len(KINDS))])[kind]
    nearest, within, above = np.full(len(kind), -1), np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
    for at in levels[1:]:
        up = parent[at]
        linked[at] = linked[up] | (kind[up] == _LINK)
        above[at] = above[up] | hint[up]
        nearest[at] = np.where(section[up] >= 0, section[up], nearest[up])
        within[at] = within[up] | np.where(section[up] >= 0, 1 << np.maximum(section[up], 0), 0)
    total = _below(np.column_stack([own, own[:, 0] * (linked & is_text)]), parent, levels)
    chars, stops, count, mark, link = total.T
    whole = chars[base[page]]
    before = np.concatenate([[0], np.cumsum(own[:, 0])])[:-1]  # characters of the page before the node
    before = before - before[base[page]]
    size = np.maximum(chars, 1)
    share = chars / np.maximum(whole, 1)
    numbers = np.column_stack([np.log1p(chars) / 5, link / size, np.minimum(stops / size * 20, 2), np.log1p(count) / 3, np.log1p(chars / np.maximum(count, 1)) / 5, share, before / np.maximum(whole, 1), (before + chars) / np.maximum(whole, 1), (chars < 30) * 1.0, (mark > 0) * (chars < 200) * 1.0])
    bits = ((hint[:, None] >> np.arange(len(HINTS))) & 1).astype(float)
    # what stands above a node speaks for it as well: the families of its ancestors, in three groups
    groups = np.column_stack([(above & m) > 0 for m in (_mask("menu", "header", "footer", "sidebar", "related"), _mask("advert", "notice", "comment", "form", "share"), _mask("article", "content"))]).astype(float)
    sections = np.column_stack([np.eye(len(_SECTIONS) + 1)[nearest][:, :-1], (within[:, None] >> np.arange(len(_SECTIONS))) & 1])
    features = np.column_stack([np.ones(len(kind)), np.eye(len(KINDS))[kind], bits, numbers, groups, sections])
    pair = _CLASS_OF[kind[np.maximum(parent, 0)]] * N_CLASSES + _CLASS_OF[kind]
    keep = chars > 0  # elements without text are no variables; what is left is a tree
    number = np.cumsum(keep) - 1
    kept_parent = np.where(parent[keep] >= 0, number[np.maximum(parent[keep], 0)], -1)
    node = (np.arange(len(kind)) - base[page])[keep]
    levels = [number[at[keep[at]]] for at in levels]
    return Forest(page[keep], node, kept_parent, pair[keep], features[keep], [at for at in levels if len(at)])


def _mask(*names: str) -> int:
    return sum(1 << HINTS.index(n) for n in names)


@dataclass
class Model:
    weights: np.ndarray  # features
    pairs: np.ndarray  # pairs of classes x parent's label x child's label


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def marginals(f: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals by messages up, then down: of each node (nodes, 2), and of it with its parent (nodes, 2, 2)."""
    n = len(f.parent)
    score = np.zeros((n, 2))
    score[:, 1] = f.features @ model.weights
    tie = model.pairs[f.pair]
    up = np.zeros((n, 2))
    for at in reversed(f.levels[1:]):  # all children of these nodes have sent
        up[at] = _log_sum(score[at][:, None, :] + tie[at], 2)
        _add(score, f.parent[at], up[at])
    belief, both = score, np.zeros((n, 2, 2))
    for at in f.levels[1:]:
        rest = belief[f.parent[at]] - up[at]  # what the parent knows from elsewhere
        joint = rest[:, :, None] + tie[at] + belief[at][:, None, :]
        both[at] = joint
        belief[at] += _log_sum(rest[:, :, None] + tie[at], 1)
    single = np.exp(belief - _log_sum(belief, 1)[:, None])
    both = np.exp(both - _log_sum(both.reshape(n, 4), 1)[:, None, None])
    return single, both


def labels_of(pages: Sequence[Page], f: Forest) -> np.ndarray:
    """A text's label is that of the nearest element above with the attribute ``LABEL``; an element's that of most of its text."""
    sizes = np.array([len(p.tag) for p in pages], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    given = np.zeros(int(sizes.sum()), bool)
    length = np.zeros(len(given))
    for p, b in zip(pages, base.tolist(), strict=True):
        for i, (up, raw, text) in enumerate(zip(p.parent, p.attributes, p.text, strict=True)):
            mark = attributes(raw).get(LABEL) if LABEL in raw else None
            given[b + i] = mark == "content" if mark else up >= 0 and given[b + up]
            length[b + i] = len(text)
    at = base[f.page] + f.node
    own = np.column_stack([length[at], length[at] * given[at]])
    total = _below(own, f.parent, f.levels)
    return (total[:, 1] * 2 > total[:, 0]).astype(np.int64)


def fit(pages: Sequence[str], steps: int = STEPS) -> Model:
    """Potentials by maximum likelihood, with a penalty on their squares, from at most ``FIT_PAGES`` labelled pages."""
    parsed = [parse(p) for p in pages[:FIT_PAGES]]
    f = forest(parsed)
    y = labels_of(parsed, f)
    child = f.parent >= 0
    seen = np.zeros((N_CLASSES**2, 2, 2))
    np.add.at(seen, (f.pair[child], y[f.parent[child]], y[child]), 1.0)
    model = Model(np.zeros(N_FEATURES), np.zeros((N_CLASSES**2, 2, 2)))
    moments = [np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.zeros_like(model.pairs), np.zeros_like(model.pairs)]
    for t in range(1, steps + 1):
        single, both = marginals(f, model)
        expected = np.zeros_like(seen)
        _add(expected, f.pair[child], both[child])
        for k, (value, up) in enumerate(((model.weights, f.features.T @ (y - single[:, 1])), (model.pairs, seen - expected))):
            slope = up / len(parsed) - PENALTY * value
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            value += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_pages(FIT_PAGES))


def content_of(pages: Sequence[str], model: Model) -> list[tuple[str, float]]:
    """Of each page the text, and the smallest distance of a text's marginal from one half (1 for none): how sure it is."""
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    f = forest(parsed)
    p = marginals(f, model)[0][:, 1] if len(f.page) else np.zeros(0)
    kept: list[set[int]] = [set() for _ in parsed]
    for i, node in zip(f.page[p >= 0.5].tolist(), f.node[p >= 0.5].tolist(), strict=True):
        kept[i].add(node)
    sure = np.full(len(parsed), 0.5)
    texts = np.array([parsed[i].tag[k] == "#text" for i, k in zip(f.page.tolist(), f.node.tolist(), strict=True)], bool)
    np.minimum.at(sure, f.page[texts], np.abs(p - 0.5)[texts])
    return [(joined(page.pieces, _Set(k)), 2 * s) for page, k, s in zip(parsed, kept, sure.tolist(), strict=True)]


class _Set:
    def __init__(self, held: set[int]):
        self.held = held

    def __getitem__(self, node: int) -> bool:
        return node in self.held


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("certainty", pa.float64())])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars and certainty of every row of ``pages`` (page_id, url, html)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks([batch], "html"):
                found = content_of([x or "" for x in b.column("html").to_pylist()], model)
                columns = [b.column("page_id"), b.column("url"), [t for t, _ in found], [len(t) for t, _ in found], [s for _, s in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, certainty double")
