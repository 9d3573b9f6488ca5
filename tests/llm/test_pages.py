"""Main text of pages that are marked up badly, oddly or hostilely."""

import html
import re
import time

import pytest

from tracelake.llm.html_extract import main_text

LONG = "One sentence of the article, with commas, and so on, for a while yet."


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<div class="content no-sidebar"><p>{LONG}</p></div>', LONG),
        (f'<article><p title="the hidden path">{LONG}</p><p data-id="reply">{LONG}</p></article>', f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><figure><img src=x><figcaption>What it shows</figcaption></figure></article>", f"{LONG}\nWhat it shows"),
        (f"<body><article><p>{LONG}</p></article><article><p>Another, shorter.</p></article></body>", f"{LONG}\nAnother, shorter."),
        ("<article><p>a <b and c then more words here, ok</p></article>", "a <b and c then more words here, ok"),
        (f'<div id="wrap"><section><p>{LONG}</p><p>{LONG}</p></section><section><p>Less, here.</p><p>{LONG}</p></section><ul><li>item</li></ul><p>End.</p></div>', f"{LONG}\n{LONG}\nLess, here.\n{LONG}\nitem\nEnd."),
        (f'<div class="menu"><p>{LONG}</p></div>', LONG),
        (f'<div id=sideBar2><p>{LONG} x</p></div><div role="complementary">Aside, here.</div><div class="advertising-slot">Buy.</div><div class="postBody"><p>{LONG}</p></div>', LONG),
        (f'<main role="main"><p>{LONG}</p><ol id="postComments"><li>First!</li></ol></main>', LONG),
        (f'<body><div class="ad">Buy, buy, buy this thing today, please do.</div><div><p>{LONG}</p></div><article class="comment"><p>{LONG} No.</p></article></body>', LONG),
        ("<p>1 < 2 &amp; 3 &gt; 2, &#8364;</p><!-- no --><![CDATA[x]]>", "1 < 2 & 3 > 2, €\nx"),
        (f'<div class="notice-board">{f"<p>{LONG}</p>" * 10}</div><p>Short, here, a paragraph.</p>', "\n".join([LONG] * 10) + "\nShort, here, a paragraph."),
        (f'<div class="post-share-content">{f"{LONG} " * 10}</div><p>Short, here, a paragraph.</p>', " ".join([LONG] * 10) + "\nShort, here, a paragraph."),
        (f'<div class="comments">{f"<p>{LONG}</p>" * 30}</div><p>{LONG}</p>', LONG),
        (f'<div class="cookie-notice"><p>{LONG}</p></div><p>A short article.</p>', "A short article."),
        (f"<header><h1>Site</h1></header><article><header><h1>Title</h1>By me<nav>Menu</nav></header><p>{LONG}</p><footer>End</footer></article>", f"Title\n{LONG}"),
        (f"<b><i>{LONG}</b> tail</i><div><p>{LONG}</div></p>", f"{LONG} tail\n{LONG}"),
        ("<!-- never closed <p>text</p>", ""),
        ("no markup", "no markup"),
        ("", ""),
        (None, ""),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("piece", ["<a ", '<a x="', "<a x='", "<", "<!--", "<!", "<p class=", "&", "<b>", "<p>", "<b><p>x", "<li>x", "<div class=menu>x", "<td><a href=x>y"])
def test_time_grows_with_length_alone(piece):
    began = time.perf_counter()
    main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 6


@pytest.mark.parametrize("first, second", [("<b>", "<hr>"), ("<b>", "</i>"), ("<div>", "</p>"), ("<b>", "<p>a, b, and c, more words than that</p>"), ("<i>", "</b>"), ("<div>", "</div>"), ("<div class=menu>", "<p>x"), ("<ul><li>", "</li>")])
def test_time_of_unbalanced_markup(first, second):
    n = 500_000 // max(len(first), len(second))
    began = time.perf_counter()
    main_text(first * n + second * n)
    assert time.perf_counter() - began < 6


def test_given_pages(spark):
    """Every page at hand has one article of headings and paragraphs: its text by two substitutions."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()]
    for page in pages:
        want = []
        for block in re.split(r"</?(?:p|h1)>", page.split("<article>")[1].split("</article>")[0]):
            text = html.unescape(re.sub("<[^>]+>", " " if "<br" in block else "", block))
            want += [x] if (x := re.sub(r"\s+", " ", text).strip()) else []
        assert main_text(page) == "\n".join(want)
    assert len(pages) > 1000
