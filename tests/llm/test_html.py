"""Main text of pages against a plain version that knows how the pages are made."""

from __future__ import annotations

import html
import re
import time

import numpy as np
from pyspark.sql import functions as F

from haystrata.llm import html_text


def plain(page: str) -> str:
    """The article element of the generated pages, tags cut out, block by block."""
    found = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.S)
    blocks = re.split(r"</?(?:p|h1|br|div|section|ul|li)\b[^>]*>", found[1])
    return " ".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if x)


def test_pages_against_plain(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r.page_id: plain(r.html) for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == texts
    assert all(r.n_chars == len(r.text) for r in got)


def test_ratios_decide(monkeypatch):
    page = "<body><div><a>Home</a><a>News</a></div><div><p>{0}</p><p>short end</p></div><div><p>Follow</p><p>us</p><p>now</p></div></body>".format("many words of a text stand here " * 9)
    assert html_text.main_text(page).endswith("short end") and "Follow" not in html_text.main_text(page) and "Home" not in html_text.main_text(page)
    monkeypatch.setattr(html_text, "ratios", lambda lines: np.ones(len(lines.lines)))
    assert "Follow" in html_text.main_text(page)


def test_names_and_divisions():
    body = "<p>" + "words in the body " * 20 + "</p>"
    text = html_text.main_text
    assert text(f"<main><p id='social-science'>Social science.</p><div class='article-header'><h1>Head</h1></div>{body}</main>").startswith("Social science. Head words")
    assert text(f"<article>{body}</article><div>Menu one two</div><article><p>teaser</p></article>").endswith("body")
    assert text(f"<main>{body}<section id='comments'><p>Great post</p></section><div class='cookie-notice'>We use cookies</div><form>Name <input></form></main>").endswith("body")
    assert text(f"<article>{body}<p>end &amp; out</p>") .endswith("body end & out")
    assert text(None) == text("") == text("<script>var a = '<p>x</p>'</script>") == ""


def test_hostile_pages_take_linear_time():
    def seconds(n: int) -> float:
        began = time.perf_counter()
        for page in ("<div>" * n + "x" + "</b>" * n + "</span></i>" * n, "<b><i>" * n + "y" + "</u>" * n + "</b>" * n, "<p><nav><li>" * n + "</x></form>" * n):
            html_text.main_text(page)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(8000) < 40 * seconds(1000) + 0.5


def test_empty_repeated_and_clashing(spark):
    rows = [(1, "u", "<p>one", 1), (1, "u", "<p>one", 1), (None, None, None, None), (3, "v", "<p>" + "long " * 100_000, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((str(r.page_id), len(r.text), r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [("1", 3, 3), ("1", 3, 3), ("3", 499_999, 499_999), ("None", 0, 0)]
    assert html_text.extract(pages.filter(F.lit(False))).count() == 0
