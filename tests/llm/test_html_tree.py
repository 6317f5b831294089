"""Messages against enumeration, parsing, and extraction on pages with known text."""

import html
import itertools
import re

import numpy as np
import pytest

from tessera.llm import html_tree as m


def test_marginals_equal_enumeration():
    tree = m.parse("<div><p>one, two.</p><ul><li><a>x</a></li></ul></div><p>three</p>")
    index = {f: i for i, f in enumerate(sorted({f for fs in tree.features for f in fs}))}
    rng = np.random.default_rng(1)
    w, table = rng.normal(size=len(index)), rng.normal(size=(2, 2, 2))
    forest = m.Forest([tree, m.parse("<p>other"), tree], index)
    p, joint = forest.beliefs(w, table)
    n = len(tree.parent)
    total, mass, edge = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        s = sum(w[index[f]] for i in range(n) if y[i] for f in tree.features[i])
        s += sum(table[int(tree.text[i] is not None), y[q], y[i]] for i, q in enumerate(tree.parent) if q >= 0)
        e = np.exp(s)
        total += e
        mass += e * np.array(y)
        for i, q in enumerate(tree.parent):
            if q >= 0:
                edge[i, y[q], y[i]] += e
    assert p[:n] == pytest.approx(mass / total) and p[-n:] == pytest.approx(mass / total)
    assert joint[1:n] == pytest.approx(edge[1:] / total)


@pytest.mark.parametrize("source, runs", [
    ("<p><b>A &amp; B<br>c\n d<p>two", ["A & B c d", "two"]),
    ("a<script>if (a</b>) '</p>'</script>b<style>p{}</style><!-- <p>no --> c", ["a", "b", "c"]),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>t", ["x", "y", "z", "t"]),
    ("<head><title>T &am</title><body>b &am &copy x", ["b &am © x"]),
    ("<DIV CLASS='q' title=\"a>b\">in<div>deep</div>out</DIV>", ["in", "deep", "out"]),
    ("1 < 2 <3 & 4<", ["1 < 2 <3 & 4<"]),
    ("<p>unclosed <a href=\"x", ["unclosed"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("", []), (" \n ", []), ("<p></p>", []),
])
def test_parse(source, runs):
    assert [t for t in m.parse(source).text if t is not None] == runs


def _article(source):
    """Main text of a fixture page by its template: heading and paragraphs of
    the article."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_fixture_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    truth = {r.page_id: _article(r.html) for r in pages.collect()}
    got = m.main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == truth
    assert all(r.n_chars == len(r.text) for r in got)


FURNITURE = """<html><head><title>t</title></head><body><header class="site-header"><h2>Site name</h2><form><label>Search</label><button>Go</button></form></header>
<div class="cookie-notice"><p>We use cookies, and this long sentence says so at length, twice over if need be.</p></div>
<div id="sidebar"><ul><li><a href="#">Link one</a></li><li><a href="#">Link two</a></li></ul></div>
<main><h1>Title</h1><p>First paragraph of the text, long enough to look like one, with commas.</p><p>Second paragraph, also of some length, and it ends here.</p>
<div class="advert"><p>Buy this now, it is cheap and good, and you will like it.</p></div></main>
<section class="comments"><p>I disagree with this, says a reader, in a long comment.</p></section><footer><p>Contact, imprint.</p></footer></body></html>"""


def test_other_furniture(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = m.train(pages)
    want = "Title\nFirst paragraph of the text, long enough to look like one, with commas.\nSecond paragraph, also of some length, and it ends here."
    rows = [(1, "u", FURNITURE, "x"), (1, "u", FURNITURE, "x"), (None, None, None, "x"), (2, "v", "", "x"), (3, "w", "<nav><a>menu</a></nav>", "x"),
            (4, "z", "<article><p>" + "Long text, again. " * 20000 + "</article>", "x")]
    got = m.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert sorted((r.page_id or 0, r.text) for r in got)[:4] == [(0, ""), (1, want), (1, want), (2, "")]
    assert {r.page_id: r.n_chars for r in got}[4] == len("Long text, again. " * 20000) - 1
    assert {r.page_id: r.text for r in got}[3] == ""


def test_given_labels_and_empty_tables(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    known = spark.createDataFrame([(r.page_id, _article(r.html)) for r in pages.collect() if r.page_id % 2], "page_id long, text string")
    model = m.train(pages, labelled=known)
    held = [r for r in pages.collect() if r.page_id % 2 == 0]
    got = m.content([m.parse(r.html) for r in held], model)
    assert np.mean([a == _article(r.html) for a, r in zip(got, held)]) > 0.9
    empty = pages.limit(0)
    assert m.main_text(empty).count() == 0
