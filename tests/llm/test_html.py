"""Main-text extraction: marginals against full enumeration, the tree against known readings, texts against held-out pages."""

import html
import itertools
import os
import re
import time
from collections import Counter

import numpy as np
import pytest

from lumenvec.llm import dom
from lumenvec.llm import html_extraction as hx
from lumenvec.llm import html_training as ht

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return hx.default_model()


def shown(source):
    """The tree as nested tags, with its texts."""
    p = dom.parse(source)
    below = {i: [k for k, up in enumerate(p.parent) if up == i] for i in range(-1, len(p.tag))}
    show = lambda i: p.text[i] if p.tag[i] == "#text" else f"{p.tag[i]}({' '.join(map(show, below[i]))})"
    return show(0)


@pytest.mark.parametrize("source,want", [
    ("<p>a<p>b", "html(p(a) p(b))"),
    ("<p><b>a<br><p>b</p>c", "html(p(b(a)) p(b) c)"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "html(ul(li(a) li(b ul(li(c))) li(d)) e)"),
    ("<table><tr><td>a<td><p>b<tr><td>c</table>d", "html(table(tr(td(a) td(p(b))) tr(td(c))) d)"),
    ("<table><tr><td><table><tr><td>a</table>b<td>c</table>", "html(table(tr(td(table(tr(td(a))) b) td(c))))"),
    ("<html><head><title>x</title><body><h1>a</h2>b", "html(head(title()) body(h1(a) b))"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "html(dl(dt(a) dd(b) dt(c)))"),
    ("<div></p></span>a</div></div>b", "html(div(a) b)"),
    ("<script>if(a<b)'<p>x'</script>a<style>b</style><!-- <p>c --><!>d", "html(script() a style() d)"),
    ("a < b &lt;p&gt; &amp &am; <3 </ x>y", "html(a < b <p> & &am; <3  y)"),
    ("<a title='>' href=x'y>a<a>b", "html(a(a) a(b))"),
    ("a<b title=\"c>d", "html(a)"),
    ("a<p", "html(a)"),
    ("<template>a</template><textarea><p>b</textarea>c", "html(template() textarea() c)"),
    ("", "html()"),
])
def test_trees(source, want):
    assert shown(source) == want


def test_blocks():
    p = dom.parse("<p> a <b>b</b>\n<i>c</i><br>d&nbsp;e</p>  <div>f<div>g</div>h</div><p> </p>i")
    assert dom.joined(p.pieces, [True] * len(p.tag)) == "a b c d e\nf\ng\nh\ni"


def test_long_and_deep_pages_take_linear_time(model):
    for source, want in (("<div>" * 60_000 + "x", None), ("<p><table><td>" + "<div>" * 30_000, ""), ("<b title='" * 60_000, ""), ("<" * 500_000, None), ("<li>" * 100_000 + "y", None), ("<!--" * 200_000, "")):
        began = time.perf_counter()
        (text, _), = hx.content_of([source], model)
        assert time.perf_counter() - began < 20 and (want is None or text == want)
    body = "".join(f"<p>word {i} of a long page, and more of it.</p>" for i in range(60_000))
    (text, _), = hx.content_of([f"<nav><a href=x>menu</a></nav><article>{body}</article>"], model)
    assert text.count("\n") == 59_999 and text.endswith("word 59999 of a long page, and more of it.") and "menu" not in text


def test_marginals_are_exact():
    rng = np.random.default_rng(4)
    pages = [dom.parse(s) for s in ("<div class=ad>a<p>b</p></div><p>c<b>d</b>", "<article><h1>a</h1><p>b<a>c</a></article>", "x")]
    f = hx.forest(pages)
    model = hx.Model(rng.normal(size=hx.N_FEATURES), rng.normal(size=(hx.N_CLASSES**2, 2, 2)))
    single, both = hx.marginals(f, model)
    for page in range(len(pages)):
        nodes = np.flatnonzero(f.page == page)
        total, one, two = 0.0, np.zeros((len(f.page), 2)), np.zeros((len(f.page), 2, 2))
        for labels in itertools.product((0, 1), repeat=len(nodes)):
            y = dict(zip(nodes.tolist(), labels, strict=True))
            score = sum(y[i] * (f.features[i] @ model.weights) + (model.pairs[f.pair[i], y[f.parent[i]], y[i]] if f.parent[i] >= 0 else 0) for i in y)
            weight = np.exp(score)
            total += weight
            for i in y:
                one[i, y[i]] += weight
                if f.parent[i] >= 0:
                    two[i, y[f.parent[i]], y[i]] += weight
        np.testing.assert_allclose(single[nodes], one[nodes] / total, atol=1e-9)
        inner = nodes[f.parent[nodes] >= 0]
        np.testing.assert_allclose(both[inner], two[inner] / total, atol=1e-9)


def wrong_texts(pages, model):
    """The share of texts with a wrong label, and of pages with one."""
    parsed = [dom.parse(p) for p in pages]
    f = hx.forest(parsed)
    wrong = ((hx.marginals(f, model)[0][:, 1] >= 0.5) != hx.labels_of(parsed, f)) & np.array([parsed[a].tag[b] == "#text" for a, b in zip(f.page, f.node, strict=True)])
    return wrong.mean(), len(set(f.page[wrong].tolist())) / len(pages)


def test_held_out_pages_and_families(model):
    texts, pages = wrong_texts(ht.labelled_pages(400, seed=99), model)
    assert texts < 0.002 and pages < 0.03
    for family in ("classes", "bare"):  # a layout that no training page has
        other = hx.fit(ht.labelled_pages(200, families=tuple(x for x in ht.FAMILIES if x != family)), steps=100)
        assert wrong_texts(ht.labelled_pages(100, seed=3, families=(family,)), other)[0] < 0.02


def plain_article(source):
    """The article of a page of the test tables, whose layout is known."""
    inside = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1].replace("<br>", " ")
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", inside))
    return "\n".join(x for x in parts if x)


def test_extract(spark, model):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    more = [(None, None, None), (7, "u", ""), (8, "u", "<p>"), (9, None, pages[0][2]), (9, None, pages[0][2])]
    rows = pages + more
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    want = Counter((i, u, t, len(t)) for i, u, t in ((i, u, plain_article(h) if h and len(h) > 10 else "") for i, u, h in rows))
    assert Counter(tuple(r)[:4] for r in hx.extract(df).collect()) == want
    assert hx.extract(df.limit(0)).count() == 0


def test_a_page_without_markup_is_text(model):
    assert hx.content_of(["Only words, no tags at all. And a second sentence, of some length."], model)[0][0].startswith("Only words")
