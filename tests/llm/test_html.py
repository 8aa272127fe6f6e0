"""Main text of pages: by clusters, on odd markup, and on Spark."""

import time

import numpy as np
import pytest

from latticut.llm import html

LONG = "The river runs past the old mill and the boats lie still until the bell rings in the evening. " * 3
PAGES = {
    # no element says what it is: menus and notes go by their ratios
    "plain": (f"<body><div><a href=a>Home</a><a href=b>News</a></div><div><h2>Title</h2><p>{LONG}<p>Short.<p>{LONG}</div><div><a href=c>Imprint</a> <a href=d>Contact</a></div>", ["Title", LONG, "Short.", LONG]),
    "classes": (f"<article><p class='alert-free'>{LONG}<p class=social-history>Kept.<p class=comment-list>No.<div class='ad-slot-3'>Buy.</div><div id=relatedPosts>{LONG}</div></article>", [LONG, "Kept."]),
    "two articles": (f"<main><article><p>{LONG}</article><article><p>{LONG}</article></main>", [LONG, LONG]),
    "links inside": (f"<article><p>{LONG}<p><a href=x>Linked words of the text</a><p>{LONG}<ul><li><a href=y>More</a><li><a href=z>Other</a></ul></article>", [LONG, "Linked words of the text", LONG]),
    "lists": (f"<article><p>{LONG}<ul><li>One.<li>Two.</ul></article>", [LONG, "One.", "Two."]),
    "nested marks": (f"<article><p>{LONG}<section class=comments><p>{LONG}<div><p>{LONG}</div></section><footer>{LONG}</footer></article>", [LONG]),
    "references": ("<p>a &amp; b &#233;&lt;c&gt; &nbsp; d<!-- x --><script>e</script>", ["a & b é<c> d"]),
    "nothing": ("<nav><a href=x>only</a></nav><footer>foot</footer>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert html.extract(page) == " ".join(" ".join(want).split())


def test_ratios_decide(monkeypatch):
    before = {name: html.extract(page) for name, (page, _) in PAGES.items()}
    monkeypatch.setattr(html, "smooth", lambda values, sigma: np.ones(len(values)))
    after = {name: html.extract(page) for name, (page, _) in PAGES.items()}
    assert {n for n in PAGES if before[n] != after[n]} >= {"classes", "links inside", "nested marks", "nothing"}


def test_deep_and_long_pages():
    began = time.time()
    assert html.extract("<div>" * 100_000 + f"<p>{LONG}") == " ".join(LONG.split())
    assert len(html.extract("<span>" * 20_000 + "<p>text " * 50_000)) == 5 * 50_000 - 1
    assert time.time() - began < 20


def test_on_spark(spark):
    rows = [(1, "u", PAGES["lists"][0], "x"), (1, "u", PAGES["lists"][0], "x"), (None, None, None, "x"), (2, "v", "", "x"), (3, "w", f"<p>{LONG * 5000}", "x")]
    schema = "page_id long, url string, html string, text string"
    got = sorted(html.extract_pages(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r["page_id"] or 0, r["n_chars"]))
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in got] == [(None, None, 0), (1, "u", len(LONG.strip()) + 10), (1, "u", len(LONG.strip()) + 10), (2, "v", 0), (3, "w", len((LONG * 5000).strip()))]
    assert html.extract_pages(spark.createDataFrame([], schema)).count() == 0
