"""Main text of pages that mark nothing as main, and parsing of broken pages in linear time."""

import time

import pytest

from tapeloom.llm.html_extract import Page, extract_main_text

LINE = "The report shows that prices rose again, while demand fell and nobody could say why".split()


def words(n: int, k: int = 0) -> str:
    return " ".join(LINE[(i + k) % len(LINE)] for i in range(n))


HEAD, LONG, NEXT = words(6), words(60, 2), words(40, 3)
MAIN = f"<h1>{HEAD}</h1><p>{LONG}</p><p>{NEXT}</p>"
WANT = "\n".join((HEAD, LONG, NEXT))
COMMENTS = "<p>Nice post, thanks a lot for writing it.</p><p>I do not agree.</p>"
PAGES = {
    1: (f'<div class="nav"><a href=/>Home</a> <a href=/b>News</a></div><div class="content">{MAIN}</div><div class="comments">{COMMENTS}</div><div class="footer">Copyright 2024, all rights reserved by us.</div>', WANT),
    2: (f'<div class="menu"><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></div>{MAIN}<div class="footer">Copyright 2024, all rights reserved by us.</div>', WANT),
    3: (f"<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div>{MAIN}</div>", WANT),
    4: (f"<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul><div>{MAIN}</div>", WANT),
    5: (f'<div class="navbar"><a href=1>One</a></div><div id="text">{MAIN}<ul><li>{words(9)}</li><li>{words(7)}</li></ul><blockquote>{words(12)}</blockquote></div><div class="sidebar"><p>{words(20, 2)}</p></div>', "\n".join((WANT, words(9), words(7), words(12)))),
    6: (f"<nav><a href=1>One</a></nav><div>{MAIN}</div><footer>Copyright 2024</footer>", WANT),
    7: (f'<div class="topbar">Log in</div><p>{words(12)}</p><div class="legal">Terms</div>', words(12)),
    8: (f'<nav><a href=1>One</a></nav><article>{MAIN}<ul><li>{words(9)}</li></ul><div class="comments">{COMMENTS}</div></article><div class="cookie-notice">We use cookies on this page.</div><footer>Copyright 2024</footer>', "\n".join((WANT, words(9)))),
    9: (f'<div class="page">{MAIN}</div><form><input name=q><label>Your mail address</label></form>', WANT),
}


def test_pages_without_an_article(spark):
    """Menus, footers, comments, notices and forms go though no element is marked as main; all else stays, in order."""
    sample = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    given = spark.createDataFrame([(-k, "u", f"<html><head><title>T</title></head><body>{h}</body></html>") for k, (h, _) in PAGES.items()], "page_id long, url string, html string")
    out = {-r.page_id: r.text for r in extract_main_text(sample.union(given)).where("page_id < 0").collect()}
    assert out == {k: want for k, (_, want) in PAGES.items()}


@pytest.mark.parametrize("html", ["<i>" * 200_000, "<i>" * 100_000 + "</b>" * 100_000, "<i>" * 100_000 + "<div></div>" * 100_000, "<p><object>" + "<i>" * 100_000 + "<div></div>" * 100_000, "<html>" * 100_000 + "<head><i></i>" * 100_000, '<a "> " ' * 100_000])
def test_broken_pages_are_parsed_in_linear_time(html):
    began = time.time()
    Page(html)
    assert time.time() - began < 15
