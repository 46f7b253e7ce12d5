import html
import os
import re

import numpy as np
import pytest

from quillframe.llm import html as text_of_pages
from quillframe.llm.common import table
from quillframe.llm.html import main_text, report

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="home"><div id="cookie-notice"><p>We use cookies, accept them all, please.</p></div>
<header><h1>Site name</h1><p>A slogan, long and full of marks, and so on.</p></header>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<aside><p>Sidebar, words, and more words.</p></aside>
<main><article><header><h1>Title &amp; more</h1></header><p class=lead>First <b>bold</b>&nbsp;text,
 on two   lines.<br>Next<p>Second para with <a href="x">a link</a> &lt;tag&gt; &#233;&copy
<ul><li>One<li>Two, <i>it</i></ul><table><tr><td>c1</td><td>c2</td></tr></table>
<div class="ad">Buy now, cheap, today!</div><form><label>Mail</label><input name=q><button>Go</button></form>
<blockquote>Quoted.</blockquote><!-- <p>gone</p> --><noscript><p>none</p></noscript><p hidden>secret</p>
<section id="comments"><p>Nice post, thanks, really.</p></section><footer>By A.</footer></article></main>
<footer>&copy; 2020, all rights.</footer></body></html>"""
TEXT = "Title & more\nFirst bold text, on two lines. Next\nSecond para with a link <tag> é©\nOne\nTwo, it\nc1\nc2\nQuoted."


def test_boilerplate_is_left_out():
    assert main_text(PAGE) == TEXT


def test_without_article_the_ratios_choose():
    menu = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(30))
    prose = "".join(f"<p>Sentence {i}, with some words, and marks; it goes on, and on, until here.</p>" for i in range(8))
    page = f"<html><body><div><ul>{menu}</ul></div><div><div>{prose}</div></div><div><span>Top</span></div></body></html>"
    assert main_text(page) == "\n".join(f"Sentence {i}, with some words, and marks; it goes on, and on, until here." for i in range(8))


STORY = [f"Sentence {i} of the story, with some words, and marks; it goes on, and on, until here." for i in range(9)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in STORY)


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content-sidebar-wrap"><article>{PARAGRAPHS}</article></div>',
        f'<div class="site has-sidebar"><main>{PARAGRAPHS}</main></div>',
        f'<article><div class="entry no-comments">{PARAGRAPHS}</div></article>',
        f'<div class="sidebar"><div><article>{PARAGRAPHS}</article></div></div>',
        f'<div class="two-column sidebar-left">{PARAGRAPHS}</div><div class="sidebar-left"><p>Short, other.</p></div>',
        f"<form action=x><div>{PARAGRAPHS}</div></form>",
        f'<div>{PARAGRAPHS}</div><article><a href="/x">Teaser, short.</a></article>',
        f'<main><article>{PARAGRAPHS}</article><article><p>Another teaser, short.</p></article></main>',
        f'<article>{PARAGRAPHS}</article><div id="comments">' + "".join(f"<article><p>Reader {i} says, at length, much; and more, and more, to all of it.</p></article>" for i in range(9)) + "</div>",
        f'<div class="teaser"><p>One card, with words.</p></div><div class="post">{PARAGRAPHS}</div><div class="post-comments"><p>Nice, thanks, really, all of you.</p></div>',
    ],
)
def test_wrappers_and_others(page):
    assert main_text(f"<html><body>{page}</body></html>") == "\n".join(STORY)


def test_links_inside_an_article_stay():
    page = f'<article><h1>T</h1><p><a name=top>Never closed, here.<p>{STORY[0]}</p><ul><li><a href="/1">Source one</a></li><li><a href="/2">Source two</a></li></ul></article>'
    assert main_text(page) == f"T\nNever closed, here.\n{STORY[0]}\nSource one\nSource two"


def test_the_ratios_decide(monkeypatch):
    rows = "".join(f"<div><span>Item {i}</span></div>" for i in range(90))
    page = f"<body><div>{rows}</div><div><h1>Title</h1><div>{PARAGRAPHS}</div></div><article><p>A card.</p></article></body>"
    assert main_text(page) == "\n".join(["Title", *STORY])
    monkeypatch.setattr(text_of_pages, "path_scores", lambda leaves: (np.ones(len(leaves)), np.zeros(len(leaves), bool)))
    assert "Item 5" in main_text(page)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>a<p>b", "a\nb"),
        ("<html><head><title>x</title><p>late body", "late body"),
        ("a < b and <3 &amp &lt", "a < b and <3 & <"),
        ("<article><p>x</div></p>y</article>", "x\ny"),
        ("<article><p title='a > b'>q</p><!-- open", "q"),
        ("<article><script>never closed <p>x", ""),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article><p>out", "deep"),
        ("<article>" + "</div>" * 20000 + "ok</article>", "ok"),
        ("<article><p>\ud800x</p></article>".encode("utf-8", "replace").decode(), "?x"),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_report(spark):
    rows = [(1, "u", PAGE, "t", 1), (1, "u", PAGE, "t", 1), (2, None, None, "t", 2), (None, "u", "", None, None), (3, "u", "<article><p>" + "long words, here. " * 60000, "t", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in report(df).collect()), key=str)
    long = " ".join(["long words, here."] * 60000)
    assert got == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "u", "", 0), (3, "u", long, len(long))], key=str)
    assert report(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_pages_of_the_tables(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    for r in report(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(filter(None, parts))
