"""Extraction: hand-made pages of many shapes, and the whole table against its own markup."""

from __future__ import annotations

import html
import re

import pytest

from cohortlab.llm import html_extract as H

from conftest import SF_CHECK

LONG = "This is a sentence of the article that goes on for a good while, as such sentences do. " * 3


@pytest.fixture(scope="module")
def tree(spark):
    return H.train(spark)


def test_tables_own_markup(spark):
    """The pages of the test data hold one article element with paragraphs and a heading."""
    pages = spark.read.parquet(f"{SF_CHECK}/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", inner)]
        want = "\n".join(p for p in parts if p)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_chrome_around_and_inside_the_article(tree):
    page = f"""<html><head><title>T</title><script>if (a < b) x("</p>");</script></head><body class="has-sidebar">
      <header class="site-header"><a href=/>Home</a> <p>The daily paper of the town</p></header>
      <nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
      <div class="cookie-notice"><p>We use cookies to make everything better for you and us.</p></div>
      <article><header><h1>Head &amp; line</h1></header><p>{LONG}</p>
      <aside class="related"><h2>Related</h2><p>{LONG}</p></aside>
      <p>Short.</p><div class="advert"><p>{LONG}</p></div><p>caf&eacute;&nbsp;<em>au</em>  lait&#33; a&lt;b</p>
      <form><label>Mail</label><input><button>Subscribe now</button></form>
      <section id="comments"><h3>Comments</h3><p>{LONG}</p></section></article>
      <div id="sidebar"><p>{LONG}</p></div><footer><p>Imprint {LONG}</p></footer></body></html>"""
    one = " ".join(LONG.split())
    assert H.main_text(page, tree) == f"Head & line\n{one}\nShort.\ncafé au lait! a<b"


def test_pages_without_an_article_element(tree):
    one = " ".join(LONG.split())
    page = f"<body><div id=menu><a href=x>Start</a></div><div><h1>Title here</h1><p>{LONG}<p>Tiny one.<p>{LONG}</div>" \
           "<div><a href=1>More</a> <a href=2>News</a></div>"
    assert H.main_text(page, tree) == f"Title here\n{one}\nTiny one.\n{one}"


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("plain words only", "plain words only"), ("a < b and c > d", "a < b and c > d"),
    ("<article><p>open <b>and never closed", "open and never closed"), ("<article><p>x</p><!-- <p>gone</p>", "x"),
    ("<article><p>x</p><script>var a = '<p>y</p>'", "x"), ("<article><p>one<br>two</p><P>THREE</P></ARTICLE>", "one two\nTHREE"),
    ("<nav><a href=1>only</a></nav>", ""), ("<article><p title='a>b'>kept</p></article></div></nav>", "kept"),
])
def test_corner_cases(tree, page, want):
    assert H.main_text(page, tree) == want


def test_long_broken_and_odd_tables(spark, tree):
    rows = [(1, "u", "<p" * 20_000), (2, None, "<article>" + "<p>w</p>" * 30_000), (3, "u", "<div>" * 5_000 + "deep"), (None, "u", None), (3, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = {(r.page_id, r.url): (r.text[:9], r.n_chars) for r in H.extract(pages, tree).collect()}
    assert got[(2, None)] == ("w\nw\nw\nw\nw", 59_999) and got[(None, "u")] == ("", 0)
    assert H.extract(pages.limit(0), tree).count() == 0


def test_odd_pages_take_linear_time(tree):
    import time
    t = time.time()
    for page in ("<div>" * 60_000 + "</nav>" * 60_000 + "x", "<head>" * 60_000 + "x", "<p>a" * 60_000, "<a href='" * 60_000, "<!--" * 60_000, "<" * 300_000):
        H.main_text(page, tree)
    assert time.time() - t < 30


def test_tree_fits_its_table(tree):
    wrong = sum(int(h != b[0]) for page in H.LABELLED for b, h in zip(page, H.predict(tree, H.features([b[1:] for b in page]))))
    assert wrong == 0


def test_long_quoted_values_are_no_text(tree):
    value = '{"body": 1}<p>gone</p><nav class=\'menu\'>' * 200
    long = value.replace('"', "&quot;")
    many = " ".join(f'data-{i}="a>b"' for i in range(200))
    assert len(long) > 5_000
    for page in (f'<article><div data-props="{long}"><p>kept</p></div></article>', f"<article><p {many}>kept</p></article>",
                 f'<article><p title="{long}" class=lead>kept</p></article>', "<article><p title=it's>kept</p></article>"):
        assert H.main_text(page, tree) == "kept"
    assert H.main_text('<article><p title="never>closed</p><p>kept</p>', tree) == "closed\nkept"


def test_odd_quotes_take_linear_time(tree):
    import time
    t = time.time()
    for page in ("<a b='>" * 60_001, "<a b=\"'>" * 60_001, "<a b='\" c=\"'>" * 40_001, "<a b=c=\"d e='>" * 40_001, "<a " * 90_000 + "<!", "<a b='c' >" * 40_000 + "<a b=\"" * 40_001):
        H.main_text(page, tree)
    assert time.time() - t < 30


@pytest.mark.parametrize("wrapper, end", [
    ('<div class="page has-sidebar"><article>', "</article></div>"), ('<main class="content no-comments">', "</main>"),
    ('<div class="social-science-post">', "</div>"), ('<article id="legal-notice-explained">', "</article>"),
    ('<div class="layout with-sidebar"><div class="related-reading">', "</div></div>"), ("<form><article>", "</article></form>"),
    ('<div id="sidebar"><article>', "</article></div>"),
])
def test_a_name_does_not_decide_alone(tree, wrapper, end):
    one = " ".join(LONG.split())
    page = f"<nav><a href=1>One</a></nav>{wrapper}<h1>Title here</h1><p>{LONG}</p><p>Tiny one.</p><p>{LONG}</p>{end}<div id=sidebar><p>{LONG}</p></div>"
    assert H.main_text(page, tree) == f"Title here\n{one}\nTiny one.\n{one}"


def test_links_and_short_words_in_named_wrappers_are_left_out(tree):
    teasers = "<article><h3><a href=1>One more story of the day</a></h3><p>A short <a href=1>teaser here</a></p></article>" * 3
    for page in (f'<div class="related">{teasers}</div>', "<div class='social-bar'><p>Tell others</p><p><a href=1>Here</a></p></div>",
                 f"<aside><article><p>{LONG}</p></article></aside>", f"<div class='post-comments'><p>{LONG}</p></div>",
                 f"<ol class='comment-list'><li class='comment'><article class='comment-body'><p>{LONG}</p></article></ol>"):
        assert H.main_text(page, tree) == ""


def test_formulas_and_fallbacks_are_text(tree):
    page = "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> holds</p><object><p>a chart</p></object></article>"
    assert " ".join(H.main_text(page, tree).split()) == "so x=2 holds a chart"
