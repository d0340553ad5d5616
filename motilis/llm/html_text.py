"""Main text of web pages by tree scoring.

A page is read once into a tree of its block elements; inline markup only matters for links. Elements that are never article
text go with all they hold: scripts, styles, forms, navigation, footers, asides, hidden ones, and those whose class, id or role
names such a part (adverts, notices, sidebars, share bars, reader comments, ...), unless they wrap the page's article. Every paragraph
then passes points for its length and its commas to its ancestors, half as many to the second, a third of that to the next;
a container's points are discounted by the share of its characters that stand in links. The container with the most points
is kept, with those of its siblings that read like it: headings in front of it, and containers and paragraphs with points or
prose of their own. Lists and tables of links inside are dropped. All other blocks are kept whole and in page order.

White space is what str.split knows, no-break space included; a line break inside a block counts as white space. Scores are
kept in thousandths as integers, so equal containers tie exactly and the first in page order wins. Work and memory are linear
in the page, whatever its nesting: the walk keeps its own stack and points go five levels up at most.

Defined results: null html counts as empty; a page without article text gives an empty text and 0; broken markup is read as far
as it goes, an unclosed script or comment hides the rest; repeated rows give repeated rows; null page_id and url are carried
along; an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, pieces

# names of elements by what they mean for the text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg select xmp noembed noframes".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary address legend".split())
CONTAINER = frozenset("html body main article section div center header footer nav aside form fieldset ul ol dl menu dir table thead tbody tfoot tr figure details dialog hgroup search button label video audio canvas".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("nav footer aside form button label fieldset menu dialog search dir head video audio canvas".split())
CORE = frozenset("article main".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody")}
# words of class and id: parts that are never the article, parts that aren't unless the article's own name stands beside them, names of the article
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr popup modal overlay paywall newsletter subscribe subscription "
    "sidebar nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination footer copyright share sharing social related recommended recommendations trending comment comments disqus replies respond discussion".split()
)
SOFT_PARTS = frozenset("notice notices alert signup login signin register side rail widget widgets pager toc skip header masthead topbar toolbar foot legal colophon follow popular tags tagcloud searchbox form reply rating ratings".split())
MAIN_PARTS = frozenset("article content main post entry story text body page hentry".split())
PART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# how much an element by itself says for or against being the article's container, in thousandths of a point
TAG_POINTS = {"article": 25_000, "main": 20_000, "section": 3_000, "div": 5_000, "td": 3_000, "blockquote": 3_000, "ul": -3_000, "ol": -3_000, "dl": -3_000, "form": -3_000, "address": -3_000}
NAMED_POINTS = 10_000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style|href)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SAID_OF_ANOTHER = re.compile(r"\b(?:no|not|has|have|with|without)[-_ ][a-z]+")  # has-sidebar, no-comments
LEVELS = 5
LINKED, MENU = 0.5, 0.8


def _read_attributes(tag: str, attributes: dict[str, str]) -> tuple[bool, int]:
    """Whether they name a part of the page that is not the article or hide the element, and points for a name that speaks for the article."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True, 0
    if attributes.get("role", "").lower() in PART_ROLES:
        return True, 0
    if "class" not in attributes and "id" not in attributes:
        return False, 0
    named = set(_WORDS.findall(_SAID_OF_ANOTHER.sub("", _CAMEL.sub(" ", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower())))
    own = bool(named & MAIN_PARTS) or tag in CORE
    return bool(named & PARTS or named & SOFT_PARTS and not own), NAMED_POINTS * own


class Tree:
    """Block elements in page order: parent, tag, whether they go, and blocks of text with the element that each stands in."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.goes, self.points = [-1], ["html"], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of it in links
        self.has_block = [False]
        self._read(html)

    def _read(self, html: str) -> None:
        stack, depth_of = [0], {"html": 1}
        held: list[str] = []
        linked, link_at = 0, 0  # characters of the block that stand in links, depth of the stack at which a link is open
        at, end, tags = 0, len(html), _TAG

        def flush() -> None:
            nonlocal linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.blocks.append((stack[-1], text, min(linked, len(text))))
                held.clear()
            linked = 0

        def pop() -> None:
            nonlocal link_at
            depth_of[self.tag[stack.pop()]] -= 1
            if len(stack) < link_at:  # a link ends with the element that it began in
                link_at = 0

        def push(name: str, goes: bool, points: int) -> None:
            top = stack[-1]
            if name in PARAGRAPH or name in CONTAINER:
                self.has_block[top] = True
            self.parent.append(top)
            self.tag.append(name)
            self.goes.append(goes)
            self.points.append(points)
            self.has_block.append(False)
            stack.append(len(self.tag) - 1)
            depth_of[name] = depth_of.get(name, 0) + 1

        def said(text: str) -> None:
            nonlocal linked
            if "&" in text:
                text = unescape(text)
            held.append(text)
            if link_at:
                linked += len(text)

        while at < end:
            i = html.find("<", at)
            if i < 0:
                i = end
            if i > at:
                said(html[at:i])
            if i >= end:
                break
            nxt = html[i + 1 : i + 2]
            if nxt == "!" or nxt == "?":
                if html.startswith("<!--", i):
                    j = html.find("-->", i + 2)
                    at = j + 3 if j >= 0 else end
                else:
                    j = html.find(">", i)
                    at = j + 1 if j >= 0 else end
                continue
            m = tags.match(html, i)
            if m is None and tags is _TAG and (nxt == "/" or nxt.isalpha()):
                tags = _PLAIN_TAG  # a quote that never closes: from here on tags end at the first >
                m = tags.match(html, i)
            if m is None:
                if nxt == "/" or nxt.isalpha():
                    j = html.find(">", i)
                    at = j + 1 if j >= 0 else end
                else:
                    said("<")
                    at = i + 1
                continue
            at, name = m.end(), m[2].lower()
            if m[1]:  # an end tag
                if name == "a":
                    link_at = 0
                elif name == "p" and not depth_of.get("p"):
                    flush()
                elif depth_of.get(name):
                    flush()
                    while self.tag[stack[-1]] != name:
                        pop()
                    if len(stack) > 1:
                        pop()
                continue
            if name in RAW:
                close = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                at = (html.find(">", close.start()) + 1 or end) if close else end
                continue
            if name == "br":
                held.append("\n")
                continue
            if name == "hr":
                flush()
                continue
            if name in VOID:
                continue
            block = name in PARAGRAPH or name in CONTAINER
            attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
            if name == "a":
                link_at = len(stack) if "href" in attributes else 0
            goes, points = name in NEVER, TAG_POINTS.get(name, 0)
            if attributes and name != "html" and name != "body":
                part, more = _read_attributes(name, attributes)
                goes, points = goes or part, points + more
            if not block and not goes and not depth_of.get(name):
                continue
            if name in ("html", "body") and depth_of.get("body" if name == "body" else "html"):
                continue
            if block or goes:
                flush()
            if block:
                for other in ("p", *CLOSED_BY.get(name, ())):
                    if self.tag[stack[-1]] == other:
                        pop()
            push(name, goes, points)
        flush()


def _kept_parts(tree: Tree) -> list[bool]:
    """Whether each element stands, neither it nor any ancestor being one that goes.

    A form or a named part that holds every article and every first heading of the page wraps the page and stays."""
    n, tag, parent = len(tree.tag), tree.tag, tree.parent
    first = [t == "h1" or t in CORE and not g for t, g in zip(tag, tree.goes)]
    whole, held, titled = sum(first), [*map(int, first)], [t in ("h1", "h2") for t in tag]
    for i in range(n - 1, 0, -1):  # children come after their parents
        held[parent[i]] += held[i]
        titled[parent[i]] |= titled[i]
    kept, inside = [True] * n, [False] * n
    for i in range(1, n):
        up = parent[i]
        inside[i] = inside[up] or tag[i] in CORE
        wraps = whole and held[i] == whole and tag[i] not in CORE and (tag[i] == "form" or tag[i] not in NEVER)
        goes = tree.goes[i] and not wraps or tag[i] == "header" and not (inside[up] and titled[i])  # an article's own header has its title
        kept[i] = kept[up] and not goes
    return kept


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    if not html:
        return ""
    tree = Tree(html)
    kept, parent, tag = _kept_parts(tree), tree.parent, tree.tag
    blocks = [(e, t, k) for e, t, k in tree.blocks if kept[e]]
    if not blocks:
        return ""
    n = len(tag)
    chars, links = [0] * n, [0] * n
    for e, t, k in blocks:
        chars[e] += len(t)
        links[e] += k
    for i in range(n - 1, 0, -1):
        chars[parent[i]] += chars[i]
        links[parent[i]] += links[i]
    for i in range(1, n):  # menus that nothing else gives away
        if kept[i] and (not kept[parent[i]] or tag[i] in ("ul", "ol", "dl", "table", "div", "section") and links[i] > MENU * chars[i] > 0):
            kept[i] = False
    prose = [(e, t, k) for e, t, k in blocks if kept[e]]
    if not prose:
        return ""

    score, scored = list(tree.points), set()
    for e, t, k in prose:
        # text right inside a container that holds blocks of its own is a paragraph of that container
        up = parent[e] if e and (tag[e] in PARAGRAPH or not tree.has_block[e]) else e
        points = (1000 + 1000 * t.count(",") + 10 * min(len(t), 2000)) * (len(t) - k) // len(t)
        share = 1
        for level in range(LEVELS):
            if up < 0:
                break
            score[up] += points // share
            scored.add(up)
            share = 2 if level == 0 else share * 3
            up = parent[up]
    value = {i: score[i] * (chars[i] - links[i]) // max(chars[i], 1) for i in scored}
    best = min(value, key=lambda i: (-value[i], i))

    chosen = [False] * n
    chosen[best] = True
    if best:
        bar = max(value[best] // 5, 3000)
        texts: dict[int, str] = {}
        for e, t, _ in prose:
            texts.setdefault(e, t)
        for i in range(1, n):
            if parent[i] != parent[best] or i == best or not kept[i] or not chars[i]:
                continue
            share = links[i] / chars[i]
            if tag[i] in HEADING:
                chosen[i] = i < best
            elif tag[i] in PARAGRAPH:
                chosen[i] = chars[i] > 80 and share < 0.25 or chars[i] <= 80 and not links[i] and texts.get(i, "")[-1:] in (".", "!", "?", "。")
            else:
                chosen[i] = value.get(i, 0) >= bar and share < LINKED
    for i in range(1, n):
        chosen[i] = kept[i] and (chosen[i] or chosen[parent[i]])
    return "\n\n".join(t for e, t, _ in prose if chosen[e])


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html"):
                texts = [main_text(h) for h in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_SCHEMA)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
