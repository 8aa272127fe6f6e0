"""Main text of web pages: streaming parser events, text-to-tag ratios per line, smoothing, clustering.

Parser events are cut into lines at block tags. A line's ratio is that of its characters outside links to its
tags; lines of elements that are never article text (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments), by their tag or by what their class, id or role says, count no characters. Scripts and styles
make no lines. Ratios are smoothed by a Gaussian along the lines of one region (lists, sections and marked
elements are regions of their own, so nothing leaks in from the side), and lines above a threshold taken from the
ratios' spread are content clusters. The innermost element that holds nearly all content is the article. What is
returned, in page order, is its lines in clusters, and its other lines with a ratio above 0, such as short
paragraphs between clusters; lines that are only links, and all outside, stay out unless a cluster takes them in.

Null and empty html, and pages without content, give an empty text. One output row an input row, repeated rows
and null ids, too; other columns are left out, whatever their names. An empty table gives an empty result. A page
is read whole in one pass; time grows with its length, however deep its elements are nested.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_batches, text_column

#: HTML elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start and end break a line.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose characters are no text of the page.
SILENT = frozenset("head title script style noscript template svg math iframe object canvas audio video button select textarea datalist".split())
#: Elements that are never article text.
ASIDE = frozenset("nav header footer aside form menu dialog".split())
#: Words that mark an element that is not article text, and words that may stand beside them in one name.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets search alert".split()
)
BESIDE = frozenset("area bar block bottom box btn buttons container content fixed form global inner item items left level links list main middle module outer page panel policy post posts primary right row secondary section site slot sticky thread top unit user users view wrap wrapper zone".split())
#: Elements whose lines are smoothed by themselves.
REGIONS = frozenset("article main section div body td ul ol dl table blockquote".split())
#: Elements that can hold an article.
HOLDERS = frozenset("article main section div body".split())
#: An end tag of another kind does not close these.
SCOPES = frozenset("article main section div table td nav aside footer header form body ul ol".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


def marked(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether class, id or role name something that is no article text, or the element is hidden.

    A name is such a mark if all its words are marks, numbers or words that stand beside marks, and one is a mark:
    comment-list is, alert-free and social-history aren't.
    """
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for one in re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", value).lower().split():
                words = [w for w in SPLIT.split(one) if w and not w.isdigit()]
                if not MARKS.isdisjoint(words) and all(w in MARKS or w in BESIDE for w in words):
                    return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


class Lines(HTMLParser):
    """Collects lines: text, tags, characters inside links and the region. Of each region: its parent, and whether it can hold an article, is one, or is marked."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parent, self.holds, self.named, self.marked = [-1], [True], [False], [False]
        self.region = 0
        #: open elements: tag and the region around it (-1: it is no region)
        self.open: list[tuple[str, int]] = []
        #: how often each tag is open, in all and since each scope began
        self.total, self.scopes = Counter(), [Counter()]
        self.buffer: list[str] = []
        self.tags = self.links = self.quiet = 0

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.lines.append((text, self.tags, self.links, self.region))
            self.buffer = []
        self.tags = self.links = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "option") and self.scopes[-1][tag]:  # an open one ends here
            self._close(tag)
        mark = tag in ASIDE or bool(attrs) and tag not in ("html", "body") and marked(attrs)
        around = -1
        if mark or tag in REGIONS:
            self.flush()
            around, self.region = self.region, len(self.parent)
            self.parent.append(around)
            self.marked.append(mark or self.marked[around])
            self.holds.append(tag in HOLDERS)
            self.named.append(tag in ("article", "main") and not self.marked[-1])
        self.open.append((tag, around))
        self.quiet += tag in SILENT
        self.total[tag] += 1
        self.scopes[-1][tag] += 1
        if tag in SCOPES:
            self.scopes.append(Counter())

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        """Closes open elements up to the last one of the tag."""
        while True:
            name, around = self.open.pop()
            if name in SCOPES:
                self.scopes.pop()
            self.scopes[-1][name] -= 1
            self.total[name] -= 1
            self.quiet -= name in SILENT
            if around >= 0:
                self.flush()
                self.region = around
            if name == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if self.total[tag] if tag in SCOPES else self.scopes[-1][tag]:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            self.buffer.append(data)
            if self.total["a"]:
                self.links += len(data)


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(values, radius, mode="edge"), kernel, mode="valid")


def content_clusters(ratios: np.ndarray, regions: np.ndarray, sigma: float, threshold: float) -> np.ndarray:
    """Which lines are content: ratios smoothed along each region's lines, above the threshold times the ratios' deviation, or above half of the highest if that is less."""
    smoothed = np.zeros(len(ratios))
    order = np.argsort(regions, kind="stable")
    cuts = np.flatnonzero(np.diff(regions[order])) + 1
    for rows in np.split(order, cuts):
        smoothed[rows] = smooth(ratios[rows], sigma)
    return (smoothed > 0) & (smoothed >= min(threshold * ratios.std(), 0.5 * smoothed.max()))


def article(page: Lines, mass: np.ndarray, regions: np.ndarray, share: float) -> np.ndarray:
    """For each region whether it is inside the article: the innermost holder of at least share of the mass.

    If only one <article> or <main> has much, three quarters are enough for it.
    """
    held = np.bincount(regions, mass, len(page.parent))
    for r in range(len(page.parent) - 1, 0, -1):  # children have higher numbers
        held[page.parent[r]] += held[r]
    total, good = held[0], np.array(page.holds) & ~np.array(page.marked)
    inside = max((r for r in np.flatnonzero(np.array(page.named) & good) if held[r] >= 0.75 * total), default=-1)
    if inside < 0 or held[inside] < share * total:
        wide = max(np.flatnonzero(good & (held >= share * total)), default=0)
        named = [r for r in np.flatnonzero(np.array(page.named) & good) if held[r] >= 0.1 * total]
        inside = inside if inside >= 0 and all(_within(page, r, inside) or _within(page, inside, r) for r in named) else wide
    within = np.zeros(len(page.parent), bool)
    for r in range(len(page.parent)):
        within[r] = r == inside or r > 0 and within[page.parent[r]]
    return within


def _within(page: Lines, inner: int, outer: int) -> bool:
    while inner > outer:
        inner = page.parent[inner]
    return inner == outer


def extract(html: str | None, sigma: float = 1.0, threshold: float = 0.25, share: float = 0.9) -> str:
    """The page's main text. threshold: see content_clusters; share: see article."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    if not page.lines:
        return ""
    regions = np.array([r for *_, r in page.lines])
    mass = np.array([max(0, len(t) - k) for t, _, k, _ in page.lines])
    ratios = np.where(np.array(page.marked)[regions], 0, mass) / np.array([max(1, tags) for _, tags, _, _ in page.lines])
    content = content_clusters(ratios, regions, sigma, threshold)
    if not content.any():
        return ""
    within = article(page, np.where(content, mass, 0), regions, share)[regions]
    return " ".join(t for (t, *_), keep in zip(page.lines, within & (content | (ratios > 0)), strict=True) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, url, text and n_chars (code points) of every page."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), text_column(pages, html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    return rows.mapInArrow(run, f"{id_col} long, {url_col} string, text string").withColumn("n_chars", F.length("text").cast("long"))
