"""Main text of pages: the table's pages against their own markup, pages made by hand, odd markup and odd tables."""

import html
import random
import re
import time

import pytest

from motilis.llm import html_text

from .conftest import rows_of

PROSE = "The river rose in spring, and the town moved its market uphill, where it has stayed since."
MORE = "Nobody had planned for that, but the square was dry, wide, and close to the mill."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


AROUND = (
    '<header><a href="/">Site</a><h2>Daily</h2></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice">We use cookies, many of them, as you know.</div>',
    '<aside><p>Read also, at length, this other piece, which is long, long, long.</p></aside><form action="/s"><label>Mail</label><input><p>Sign up, now, please.</p></form><footer><p>All rights reserved, 2020, by us, the site, in full.</p></footer>',
)
HAND = {
    "article": (f"<article><h1>Flood</h1><p>{PROSE}</p><p>{MORE}</p></article>", ["Flood", PROSE, MORE]),
    "divs": (f'<div id="wrap"><div class="post-content"><h1>Flood</h1><div>{PROSE}</div><div>{MORE}</div><div>Ok.</div></div><div class="comments"><p>{PROSE * 9}</p></div></div>', ["Flood", PROSE, MORE, "Ok."]),
    "post comments": (f'<div class="post"><h1>Flood</h1><p>{PROSE}</p></div><div class="post-comments"><article class="comment-body"><p>{MORE * 9}</p></article></div>', ["Flood", PROSE]),
    "title outside": (f"<main><h1>Flood</h1><article><p>{PROSE}</p><p>{MORE}</p></article></main>", ["Flood", PROSE, MORE]),
    "own header": (f"<article><header><h1>Flood</h1><p>By A. Smith</p></header><p>{PROSE}</p><footer>Filed under floods</footer></article>", ["Flood", "By A. Smith", PROSE]),
    "parts inside": (f'<article><h1>Flood</h1><p>{PROSE}</p><div class="ad">Buy, buy, buy.</div><ul class="share"><li>Post it</li></ul><ul><li><a href="/1">First</a></li><li><a href="/2">Second</a></li></ul><p>{MORE}</p></article>', ["Flood", PROSE, MORE]),
    "lists and tables": (f"<article><p>{PROSE}<ul><li>wood<li>stone</ul><table><tr><td>1<td>2<tr><td>3</table><blockquote>{MORE}</blockquote><pre>a\n  b</pre></article>", [PROSE, "wood", "stone", "1", "2", "3", MORE, "a b"]),
    "whole page in a form": (f'<form id="aspnetForm"><div class="has-sidebar"><article><h1>Flood</h1><p>{PROSE}</p></article><div class="sidebar"><p>{MORE}</p></div></div></form>', ["Flood", PROSE]),
    "sections": (f"<article><h1>Flood</h1><section><h2>I</h2><p>{PROSE}</p></section><section><h2>II</h2><p>{MORE}</p></section></article>", ["Flood", "I", PROSE, "II", MORE]),
    "bare text": (f"{PROSE}<br>{MORE}<hr>{PROSE}", [f"{PROSE} {MORE}", PROSE]),
    "references": ("<article><p>A &amp; B &lt;c&gt; &#233;&#x65E5;&nbsp;&eacute; &unknown; x<b>y</b>z\n\t w<!-- <p>no</p> --></p><script>var a='</p><p>no</p>';</script><style>p{}</style></article>", ["A & B <c> é日 é &unknown; xyz w"]),
    "a long comment thread": (f'<div class="story"><p>{PROSE}</p></div><section id="disqus_thread"><p>{MORE * 50}</p></section>', [PROSE]),
    "linked words": (f'<article><p>{PROSE} <a href="/x">{MORE}</a></p></article>', [f"{PROSE} {MORE}"]),
    "hidden": (f'<article><p>{PROSE}</p><p hidden>no</p><p style="display: none">no</p><div aria-hidden="true">no</div></article>', [PROSE]),
}


@pytest.mark.parametrize("name", HAND)
def test_pages_made_by_hand(name):
    body, want = HAND[name]
    assert html_text.main_text(page(body)) == "\n\n".join(want)
    if name != "bare text":
        assert html_text.main_text(page(AROUND[0] + body + AROUND[1])) == "\n\n".join(want)


def test_pages_of_the_table(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = html_text.op12_html_text(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"<br>|</?p>|</?h1>", inner)]
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, "\n\n".join(b for b in blocks if b), len(r.text))


def test_broken_markup_never_fails_and_stays_linear():
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div class='ad", "<a href=\"x", "<!--", "-->", "<", ">", "</", "&am", "&#xZ;", "\0", "<script>", "</script>", "text, more. ", '"', "'", "<b", "<li>", "</table>", "<td>", "</html>", "é"]
    for _ in range(2000):
        html_text.main_text("".join(rng.choice(bits) for _ in range(rng.randrange(40))))
    began = time.process_time()
    for body in ("<div>" * 60_000, "</div>" * 60_000, "<b>" * 60_000 + "<p>x" * 60_000, '<a "' * 60_000, "<!-- " * 60_000, "<ul><li>" * 60_000 + "x", "<script>" * 60_000, "<p>a, b.</p>" * 60_000, "&" * 300_000, "<span class=ad>" * 60_000):
        html_text.main_text(body)
    assert time.process_time() - began < 30


def test_odd_tables(spark):
    rows = [(1, "u", page(HAND["article"][0])), (1, "u", page(HAND["article"][0])), (None, None, None), (2, None, ""), (3, "v", "<nav>only</nav>"), (4, "w", "<article><p>" + "x, y. " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = "\n\n".join(HAND["article"][1])
    want = [(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, None, "", 0), (3, "v", "", 0), (4, "w", ("x, y. " * 100_000).strip(), 599_999)]
    assert rows_of(html_text.extract(df)) == sorted(want, key=repr)
    from pyspark.sql import functions as F

    assert rows_of(html_text.extract(df.withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("a")).repartition(3))) == sorted(want, key=repr)
    assert html_text.extract(df.limit(0)).count() == 0
