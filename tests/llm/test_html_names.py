"""Elements whose names look like furniture but that hold the article, and pages that are nothing but depth."""

import time

import pytest

from cuesheet.llm import html_text

LINES = ["A sentence of the article, which is long enough. " * 8, "Another one, also long, and with a comma. " * 9]
BODY = "".join(f"<p>{x}</p>" for x in LINES)
WANT = "\n".join(x.strip() for x in LINES)
SIDE = '<div class="sidebar"><ul><li><a href=x>one</a><li>two</ul></div><div class="ad">Buy this, now.</div>'


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "post related-wide", "entry tags-on", "banner-image story", "ad-free"])
@pytest.mark.parametrize("frame", ["", "article", "main"])
def test_names_of_the_element_that_holds_the_article(name, frame):
    inner = f'<div class="{name}">{BODY}{SIDE}</div>'
    inner = f"<{frame}>{inner}</{frame}>" if frame else inner
    assert html_text.main_text(f"<html><body>{SIDE}{inner}{SIDE}</body></html>") == WANT


def test_furniture_stays_furniture_on_short_pages():
    page = f'<body><div class="ad">{"A long advert, longer than the article. " * 5}</div><article><p>Short.</p></article></body>'
    assert html_text.main_text(page) == "Short."
    comments = f'<article>{BODY}<div class="comments"><p>First!</p></div></article>'
    assert html_text.main_text(comments) == WANT


@pytest.mark.parametrize("part", ["<b>x", "<div>x.", "<p>a<td>b", "<li>x</i>", "<a><p class=ad>y</a>"])
def test_time_follows_the_page_and_not_its_depth(part):
    def seconds(n):
        start = time.process_time()
        html_text.main_text(part * n)
        return time.process_time() - start

    seconds(2_000)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)
