"""HTML extraction off the given template, on hostile markup and on odd tables."""

from __future__ import annotations

import re
import time
from collections import Counter

import pytest

from quotemill.llm import html_text

PARAGRAPH = " ".join(f"word{i}" for i in range(40))
ARTICLE = f"<p>{PARAGRAPH}</p>" * 6


@pytest.mark.parametrize(
    "wrapper",
    [
        '<article class="overflow-hidden">',
        '<div class="post has-sidebar">',
        '<div class="entry comments-closed">',
        '<div class="content nav-open">',
        '<div id="side-project">',
        '<div data-note="hidden gems">',
        "<div>",
    ],
)
def test_wrappers_that_name_states_keep_their_article(wrapper):
    name = wrapper[1:].split()[0].rstrip(">")
    page = f"<body><nav><a href=/>home</a></nav>{wrapper}{ARTICLE}</{name}><footer>legal words here</footer></body>"
    assert html_text.extract(page) == " ".join([PARAGRAPH] * 6)


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div class="sidebar">',
        '<div class="site-footer">',
        '<ul id="main-menu">',
        '<section class="comments">',
        '<div class="cookie-banner">',
        "<div hidden>",
        '<div hidden="hidden">',
        '<div style="color:red; display : none">',
        '<div aria-hidden="true">',
        '<div role="navigation">',
        "<aside>",
    ],
)
def test_parts_without_content_are_dropped(wrapper):
    name = wrapper[1:].split()[0].rstrip(">")
    assert html_text.extract(f"<body><article>{ARTICLE}</article>{wrapper}<p>{PARAGRAPH} else</p></{name}></body>") == " ".join([PARAGRAPH] * 6)


def test_short_paragraphs_of_a_plain_part_are_text():
    line = "a b c d e f g h i j k l"
    assert html_text.extract("<div>" + f"<p>{line}</p>" * 6 + "</div>") == " ".join([line] * 6)


def test_words_and_links_decide_where_no_name_helps(spark):
    """Without main parts, classes and ids nearly all of the articles is found by the tree alone."""
    kept = whole = 0
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        page = row.html or ""
        bare = re.sub(r"</?(?:main|article)\b[^>]*>", "", page)
        bare = re.sub(r"\s(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", bare)
        want = Counter(html_text.extract(page).split())
        kept += sum((want & Counter(html_text.extract(bare).split())).values())
        whole += sum(want.values())
    assert kept >= 0.95 * whole


@pytest.mark.parametrize("piece", ["<a ", "<a '>", "<a \">x", "<div>", "<p><b>", "</x>", "<!--", "<!", "<script>", "<a href='x'>y", "&amp", "<<<"])
def test_hostile_pages_take_time_in_proportion(piece):
    def seconds(n):
        began = time.perf_counter()
        html_text.extract(piece * (n // len(piece)))
        return time.perf_counter() - began

    assert seconds(400_000) < 8 * max(0.1, seconds(100_000))


def test_quotes_hold_closing_brackets_and_unclosed_parts_swallow_the_rest():
    assert html_text.extract(f"<article><img alt='a > b'><p title=\"<x>\">{PARAGRAPH}</p></article>") == PARAGRAPH
    assert html_text.extract(f"<article><p>{PARAGRAPH}</p><!-- open <p>more</p></article>") == PARAGRAPH
    assert html_text.extract(f"<article><p>{PARAGRAPH}</p><script>var a = '<p>more</p>';") == PARAGRAPH
    assert html_text.extract(f"<article><p>{PARAGRAPH}</p>tail <a href") .startswith(PARAGRAPH)


def test_odd_tables(spark):
    kind = "page_id int, url string, html string, text string, main string"
    page = f"<article><p>{PARAGRAPH}</p></article>"
    pages = spark.createDataFrame([(1, None, None, "t", "m"), (2, "u", "", "t", "m"), (3, "u", page, "t", "m"), (3, "u", page, "t", "m")], kind)
    got = html_text.extract_text(pages, into="found").select("page_id", "text", "found.text").collect()
    assert sorted(map(tuple, got)) == [(1, "t", ""), (2, "t", ""), (3, "t", PARAGRAPH), (3, "t", PARAGRAPH)]
    assert html_text.extract_text(pages.filter("false"), into="found").count() == 0
