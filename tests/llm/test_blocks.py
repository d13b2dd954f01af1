"""Main text: cutting, both passes of rules, and whole pages."""

import random

import duckdb
import html as references
import numpy as np
import re

import pytest

from eventscope.llm import blocks, queries

LONG = "This is the text of the article, and it is long enough for a block to be taken by itself."
PLAIN = "Xanth qorblat zimwer plonk drissel vantor kelmip jorbex hassel wexlum torvax quendil mirpol."


def text_of(page):
    texts, _, content = blocks.labelled([page])
    return "\n".join(t for t, c in zip(texts, content) if c)


def test_article_without_the_rest():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
    <!-- ad 1 --><div class="ad">{LONG}</div><div id="cookie-notice">{LONG}</div>
    <article><header class="entry-header"><h1>A &amp; B</h1><div>by someone</div></header>
    <p>One&nbsp;<b>bold</b>   line<br>more.<p>{LONG}</p><div class="ad-slot"><p>{LONG}</p></div><p>Sh is.</p>
    <aside>{LONG}</aside><form><p>{LONG}</p><input></form><section class="article-comments"><p>{LONG}</p></section>
    </article><aside class="sidebar"><p>{LONG}</p></aside><footer>&copy; us</footer><noscript>{LONG}</noscript>"""
    assert text_of(page) == f"A & B\nOne bold line more.\n{LONG}\nSh is."


def test_page_without_article():
    page = f"""<div><a href=1>Home</a> | <a href=2>News</a></div><h2>Title</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p>
    <ul><li><a href=3>{LONG}</a></li></ul><p>Copyright © somebody who has the rights of all that is on this page</p>"""
    assert text_of(page) == f"Title\n{LONG}\nShort one.\n{LONG}"


def test_other_language_is_judged_by_length():
    assert text_of(f"<p>{PLAIN} {PLAIN}</p><div><a href=1>zok</a></div>") == f"{PLAIN} {PLAIN}"
    assert text_of(f"<article><p>{PLAIN}</p><p>zok</p></article>") == f"{PLAIN}\nzok"


@pytest.mark.parametrize("page, cut", [
    ("", []), ("no tags", ["no tags"]), ("<p>a<p>b", ["a", "b"]), ("a < b &lt; c &am &amp d", ["a < b < c &am & d"]),
    ("<p title='x > y'>a</p>b", ["a", "b"]), ("<p title=\"x>a</p>b", ["a", "b"]), ("a<!-- x -- > <p>b", ["a"]),
    ("a<!-->b", ["ab"]), ("<script>x</SCRIPT >y", ["y"]), ("<style>x", []), ("<b>a<div>b</b>c</div>d", ["a", "bc", "d"]),
    ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("a</p></div>b", ["a", "b"]), ("<p>x</p", ["x"]), ("f<i>oo</i>bar \n x", ["foobar x"]), ("<?xml?>a<!x>b", ["ab"]),
])
def test_cut(page, cut):
    assert [b[0] for b in blocks.cut(page)] == cut


def test_unclosed_menu_ends_at_the_article():
    assert text_of(f"<nav><a href=1>Home</a><article><p>{LONG}</p></article>") == LONG


def test_time_grows_with_length():
    import time

    def seconds(page):
        started = time.process_time()
        blocks.labelled([page])
        return time.process_time() - started

    for unit in ("<div>", "<b>", "<b></i>", "<p>x", "<a href='>", "<li>x", "</div>", "<!--", "<", "&", "<nav>", "<td><b>"):
        assert seconds(unit * 40_000) < 12 * max(seconds(unit * 8_000), 0.02), unit


def test_second_pass_as_a_search():
    """Each open block looks left and right by itself."""
    draw = random.Random(3)
    for _ in range(200):
        n = draw.randint(1, 30)
        page = np.sort(np.array([draw.randint(0, 2) for _ in range(n)]))
        region = np.array([draw.choice((0, 0, 1, 2)) for _ in range(n)])
        heading = np.array([draw.random() < 0.2 for _ in range(n)])
        label = np.array([draw.choice((-1, -1, 0, 1)) for _ in range(n)], dtype=np.int8)
        found = blocks._second_pass(label, region, page, heading)
        for i in range(n):
            same = [k for k in range(n) if page[k] == page[i] and region[k] == region[i]]
            at, want = same.index(i), label[i]
            if want == -1:
                near = {}
                for k, j in enumerate(same):
                    if label[j] != -1:
                        near.setdefault(abs(k - at), set()).add(int(label[j]))
                ahead = [int(label[j]) for j in same[at:] if label[j] != -1]
                if heading[i] and ahead:
                    near = {0: {ahead[0]}}
                article = any(region[k] for k in range(n) if page[k] == page[i])
                if not near:
                    want = 1 if region[i] or not article else 0
                else:
                    nearest = near[min(near)]
                    want = nearest.pop() if len(nearest) == 1 else int(region[i] > 0)
            assert found[i] == want


def test_operator_keeps_other_columns(spark):
    rows = [(1, "p", f"<p>{LONG}</p>", "old", 9), (1, "p", f"<p>{LONG}</p>", "old", 9), (None, None, None, None, None), (2, "q", "", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, page string, html string, text string, label int")
    out = blocks.main_text(pages)
    assert out.columns == ["page_id", "page", "html", "label", "text"]
    assert sorted((r.page_id or 0, r.text, r.label) for r in out.collect()) == [(0, "", None), (1, LONG, 9), (1, LONG, 9), (2, "", 0)]
    assert blocks.main_text(pages.limit(0)).collect() == []


def test_query_on_the_given_pages(spark):
    """These pages hold one article each, so a plain cut between its tags is enough."""
    folder = "/root/testdata/sf0.001"
    want = {}
    for page_id, page in duckdb.sql(f"SELECT page_id, html FROM '{folder}/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.S)[1].replace("<br>", " ")
        lines = [" ".join(references.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want[page_id] = "\n".join(x for x in lines if x)
    found = queries.op11_main_text(spark, folder).collect()
    assert {r.page_id: r.text for r in found} == want
    assert all(r.n_chars == len(r.text) for r in found)
