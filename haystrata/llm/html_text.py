"""Main text of web pages by text-to-tag ratios (operator 6).

Events of the standard library's streaming HTML parser are cut into lines at block bounds. A line's
ratio is its text outside links by the tags since the line before, times a weight that its elements
give: more in ``article`` and ``main``, little in menus, page headers, footers, asides, forms and
elements whose class, id or role names a part beside the article. Ratios are smoothed with a Gaussian
over line order, and lines above a threshold cluster.

The clusters' ratios select the region: from the whole page down, the division that holds most (``HOLDS``)
of the ratios of clustered lines, as far as an ``article`` or ``main``. Of such a region all lines stay but
those of divisions of little weight whose ratios are below the threshold; of any other region the
divisions with a line above it. So short paragraphs and headings of an article stay.

Text of scripts, styles, templates, titles, buttons and hidden elements is no line. An end tag without a
start tag is nothing; an inline end tag ends nothing outside its block; a block that ends ends what is
open in it. Every element is put on and taken off the stack once, so time is linear in the page.

Null and empty html give an empty text. Pages are independent: repeated rows give repeated results. Only
the named columns are read, and other columns may have any name.
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

from haystrata.llm.tokens import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style noscript template title iframe object svg canvas select button textarea".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that are divisions: a region takes in or leaves out the whole of one.
DIVISION = frozenset("article main section div td body html center blockquote nav footer aside form header dialog menu".split())
REGION = frozenset({"article", "main"})
#: Elements of little weight; a header only outside an article or main.
BESIDE = frozenset("nav footer aside form dialog menu header".split())
#: Names of parts beside the article: as the first or last part of a class, id or role, or as the whole of one.
BESIDE_PART = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr newsletter comment comments commentlist disqus replies".split())
BESIDE_NAME = BESIDE_PART | frozenset("banner promotion masthead notice notices alert popup modal overlay subscribe subscription signup login responses related recommended share sharing social widget toolbar search contentinfo complementary".split())
REGION_WEIGHT, BESIDE_WEIGHT = 3.0, 0.02
SIGMA, SPREAD, HOLDS = 1.0, 0.5, 0.8
_reach = np.arange(-3, 4)
KERNEL = np.exp(-(_reach**2) / (2 * SIGMA**2))
KERNEL /= KERNEL.sum()
_ends = re.compile(r"^([A-Za-z]+)(?:[-_].*)?$"), re.compile(r"^(?:.*[-_])?([A-Za-z]+)$")


def names_beside(value: str) -> bool:
    """Whether a class, id or role value names a part beside the article."""
    for name in value.lower().split():
        if name in BESIDE_NAME or any((m := e.match(name)) and m[1] in BESIDE_PART for e in _ends):
            return True
    return False


class _Open:
    """An open block: its division and weight, the inline elements open in it."""

    __slots__ = ("tag", "division", "weight", "muted", "inline", "counts")

    def __init__(self, tag: str, division: int, weight: float, muted: bool):
        self.tag, self.division, self.weight, self.muted = tag, division, weight, muted
        self.inline: list[tuple[str, bool]] = []
        self.counts: Counter = Counter()


class Lines(HTMLParser):
    """Lines of text (text, characters outside links, tags before it, division) and the tree of divisions."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Open("", 0, 1.0, False)]
        self.blocks: Counter = Counter()  # open blocks by tag
        self.regions = 0
        self.parents, self.tags_of, self.weights = [-1], [""], [1.0]
        self.parts: list[str] = []
        self.plain = self.tags = self.links = self.muted = 0
        self.lines: list[tuple[str, int, int, int]] = []

    def cut(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.plain, self.tags, self.stack[-1].division))
                self.tags = 0
            self.parts, self.plain = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        hidden, beside = tag in NO_TEXT, False
        for key, value in attrs:
            if key in ("class", "id", "role") and value and tag not in ("html", "body"):
                beside = beside or names_beside(value)
            hidden = hidden or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in (value or "").replace(" ", "").lower()
        if tag not in BLOCK:
            top = self.stack[-1]
            top.inline.append((tag, hidden))
            top.counts[tag] += 1
            self.links += tag == "a"
            self.muted += hidden
            return
        self.implied(tag)
        outer = self.stack[-1]
        beside = beside or tag in BESIDE and not (tag == "header" and self.regions)
        weight, division = outer.weight, outer.division
        if beside:
            weight = min(weight, BESIDE_WEIGHT)
        elif tag in REGION and weight >= 1:
            weight = REGION_WEIGHT
        if tag in DIVISION or beside:
            division = len(self.parents)
            self.parents.append(outer.division)
            self.tags_of.append(tag)
            self.weights.append(weight)
        self.blocks[tag] += 1
        self.regions += tag in REGION
        self.muted += hidden
        self.stack.append(_Open(tag, division, weight, hidden))

    def implied(self, tag: str) -> None:
        """What the start of a block ends: an open paragraph; an item of the same list; menus and forms never closed before an article."""
        if self.stack[-1].tag == "p":
            self.end()
        if tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
            for k in range(len(self.stack) - 1, max(0, len(self.stack) - 5), -1):
                if self.stack[k].tag == tag:
                    while len(self.stack) > k:
                        self.end()
                    return
                if self.stack[k].tag in ("ul", "ol", "dl", "table", "menu"):
                    return
        if tag in REGION and any(self.blocks[t] for t in ("nav", "form", "menu", "footer")):
            k = next(k for k, b in enumerate(self.stack) if b.tag in ("nav", "form", "menu", "footer"))
            while len(self.stack) > k:
                self.end()

    def end(self) -> None:
        """The innermost block and all inline elements in it."""
        self.cut()
        block = self.stack.pop()
        self.blocks[block.tag] -= 1
        self.regions -= block.tag in REGION
        self.muted -= block.muted + sum(h for _, h in block.inline)
        self.links -= block.counts["a"]

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.cut()
            self.tags += 1
            if self.blocks[tag] > 0 and tag not in VOID:
                while self.stack[-1].tag != tag:
                    self.end()
                self.end()
            return
        self.tags += 1
        top = self.stack[-1]
        if top.counts[tag] > 0:
            while True:
                name, hidden = top.inline.pop()
                top.counts[name] -= 1
                self.links -= name == "a"
                self.muted -= hidden
                if name == tag:
                    return

    def handle_data(self, data):
        if not self.muted:
            self.parts.append(data)
            if not self.links:
                self.plain += len(data) - data.count("\n")

    def finish(self) -> None:
        """Ends what the page left open."""
        while len(self.stack) > 1:
            self.end()
        self.cut()


def ratios(page: Lines) -> np.ndarray:
    """Weighted text-to-tag ratio of each line."""
    return np.array([plain / max(1, tags) * page.weights[d] for _, plain, tags, d in page.lines])


def content_lines(page: Lines) -> list[str]:
    """The lines of the region that the smoothed ratios select."""
    if not page.lines:
        return []
    ratio, division = ratios(page), np.array([x[3] for x in page.lines])
    smooth = np.convolve(np.pad(ratio, 3, mode="edge"), KERNEL, mode="valid")
    threshold = SPREAD * smooth.std()
    above = smooth >= threshold
    n = len(page.parents)
    mass, own, lines = np.zeros(n), np.zeros(n), np.zeros(n)
    np.add.at(mass, division, np.where(above, ratio, 0))
    np.add.at(own, division, ratio)
    np.add.at(lines, division, 1)
    children: list[list[int]] = [[] for _ in range(n)]
    for d in range(n - 1, 0, -1):  # a division's number is above its parent's
        mass[page.parents[d]] += mass[d]
        children[page.parents[d]].append(d)
    root = 0
    while True:
        tag = page.tags_of[root]
        articles = sum(page.tags_of[d] == "article" for d in children[root])
        best = max(children[root], key=lambda d: mass[d], default=None)
        if best is None or tag == "article" or tag == "main" and articles < 2 or mass[best] < HOLDS * mass[root]:
            break
        root = best
    inside = np.zeros(n, bool)
    inside[root] = True
    region = page.tags_of[root] in REGION
    good = np.zeros(n, bool)
    good[division[above]] = True
    for d in range(root + 1, n):
        if inside[page.parents[d]]:
            slight = page.weights[d] < 1 and own[d] < threshold * max(1, lines[d])
            inside[d] = not (region and slight)
    take = inside[division] & (good[division] | region)
    return [x[0] for x, keep in zip(page.lines, take.tolist(), strict=True) if keep]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.finish()
    return " ".join(content_lines(page))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col``, ``url_col``, text, n_chars."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "html"):
            texts = [main_text(h) for h in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    found = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
