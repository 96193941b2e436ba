"""Main text of web pages by composite text density.

Each DOM node has C characters and T tags below it, LC characters and LT tags of them in links. Its density is C / T,
adjusted for links by the logarithm of (C / LC) (T / LT) to the base ln(C LC / (C - LC) + C LCb / Cb + e), where b is
the body. A node's density sum is that of its children's densities. The subtree with the largest sum is where the
article is; the threshold is the least density on the path from it to the body. A subtree beside that path belongs to the
article too if its blocks as dense as that hold a fifth as much plain text as the maximum (a footer is dense, but short);
the result is the smallest subtree that holds the maximum and all of these.
Sums are over block elements: bold or linked words inside a paragraph count as tags but aren't places where an article
could be.

Never part of the article, and left out before: scripts, styles, forms, menus, page headers and footers, asides, and elements
whose role, class or id says advert, notice, sidebar, comments and the like (inside an article or main element only a whole name
says so). Of what is left nothing is dropped or cut: short paragraphs and headings of the subtree stay. Parsing takes time in
proportion to the page's length, however broken it is.

Defined cases: null html counts as empty and gives empty text; broken markup is closed where a browser would close it; a tag
without an end is dropped with what follows it, as browsers do; a quoted value without an end ends at the next ">"; null page_id and url are carried; repeated rows are read each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where markup begins; any other "<" is text.
BEGIN = re.compile(r"<(?:/?[a-zA-Z]|[!?/])")
#: A tag: end mark, name, attributes. Only a value behind "=" may be quoted. Possessive, so that no attempt goes back.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+)>""")
#: The same where a quote is never closed: the first ">" ends it.
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An open element on the left is closed by a start tag on the right.
CLOSES = {
    "p": BLOCK - {"body", "html"},
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot", "thead")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "option": frozenset(("option", "optgroup")),
    "head": frozenset(("body", "div", "p", "article", "main", "nav", "section", "header", "h1", "table", "ul")),
}
CLOSED_BY = {start: tuple(open_ for open_, starts in CLOSES.items() if start in starts) for start in frozenset().union(*CLOSES.values())}
#: A search for an element to close stops at these.
SCOPE = frozenset(("table", "td", "th", "body", "html", "article", "section", "main", "div", "ul", "ol", "dl"))
#: An inline end tag closes nothing beyond these.
WALLS = frozenset(("article", "main", "table", "body"))

NOT_TEXT = frozenset("head nav aside form button select option input footer menu dialog svg math object canvas audio video script style".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Class names and ids, or parts of them between hyphens, of what surrounds an article.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar side aside footer foot masthead topbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social comment comments disqus reply replies respond related recommended recommendations pagination pager widget widgets toolbar skip search".split()
)
#: Inside an article or main element only a whole class name or id tells, and only one of these.
WITHIN = frozenset("ad ads advert adverts advertisement sponsored promo sidebar cookie-notice notice newsletter share social comment comments comment-list comments-area reader-comments user-comments replies related".split())
#: Of article and main elements, only these are something else than the article.
OTHERS = frozenset("comment comments reply replies ad ads advert promo sponsored related teaser".split())
NEGATED = frozenset(("has", "with", "no"))
OWN_HEADER = frozenset("article post entry story content".split())


class Node:
    __slots__ = ("tag", "parent", "items", "skip", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, skip: bool = False):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _left_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NOT_TEXT:
        return True
    if tag == "header":
        return not in_article
    if not attributes or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name not in ("class", "id"):
            continue
        for token in value.split():
            if in_article and tag not in ("article", "main"):
                if token in WITHIN:
                    return True
                continue
            parts = token.replace("_", "-").split("-")
            if parts[0] in NEGATED:
                continue
            if not (OTHERS if tag in ("article", "main") else AROUND).isdisjoint(parts):
                return True
            if tag not in ("article", "main") and "header" in parts and OWN_HEADER.isdisjoint(parts):
                return True
    return False


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*+>?", re.I)


class _Open:
    """The open elements, with the places of each tag, so that no step searches the whole stack."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = [0]
        self.walls: list[int] = [0]

    def last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else 0

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in SCOPE:
            self.scopes.append(at)
        if node.tag in WALLS:
            self.walls.append(at)

    def close_from(self, at: int) -> None:
        for node in self.stack[at:]:
            self.places[node.tag].pop()
        del self.stack[at:]
        for marks in (self.scopes, self.walls):
            while marks[-1] >= at:
                marks.pop()


def parse(html: str) -> Node:
    """The tree; what can't be part of an article is marked `skip`. Every step moves on in the page or takes an element
    off the stack, so that broken pages cost no more than sound ones."""
    root = Node("html", None)
    open_ = _Open(root)
    at, end, shape = 0, len(html), TAG
    while (m := BEGIN.search(html, at)) is not None:
        begin = m.start()
        if begin > at:
            open_.stack[-1].items.append(html[at:begin])
        if not m[0][-1].isalpha():  # a comment, a declaration or a stray end
            comment = html.startswith("<!--", begin)
            stop = html.find("-->" if comment else ">", begin + 4 if comment else begin + 2)
            if stop < 0:
                return root
            at = stop + (3 if comment else 1)
            continue
        t = shape.match(html, begin)
        if t is None and shape is TAG:
            shape = LOOSE_TAG  # a quote without an end: from here on quotes mean nothing
            t = shape.match(html, begin)
        if t is None:  # no tag ends any more
            return root
        at, tag, attributes = t.end(), t[2].lower(), t[3]
        if t[1]:
            place = open_.last(tag)
            if place and (tag in BLOCK or place >= open_.walls[-1]):
                open_.close_from(place)
            continue
        if tag in ("html", "body") and open_.last(tag):
            continue
        place = max((open_.last(x) for x in CLOSED_BY.get(tag, ())), default=0)
        if place and place >= open_.scopes[-1]:
            open_.close_from(place)
        up = open_.stack[-1]
        in_article = bool(open_.last("article") or open_.last("main"))
        node = Node(tag, up, up.skip or _left_out(tag, attributes, in_article))
        up.items.append(node)
        if tag in RAW:
            close = _raw_end(tag).search(html, at)
            at = close.end() if close else end
        elif tag not in VOID and not attributes.endswith("/") or tag in BLOCK and tag != "hr":
            open_.push(node)
    if at < end:
        open_.stack[-1].items.append(html[at:])
    return root


def _measure(root: Node) -> list[Node]:
    """Counts and densities bottom-up; returns the nodes in document order. No recursion: trees may be deep."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        linked = linked or node.tag == "a"
        for x in node.items:
            if isinstance(x, str):
                n = len(x.split()) and len("".join(unescape(x).split()))
                node.chars += n
                node.link_chars += n * linked
        node.link_tags += node.tag == "a"
        stack.extend((x, linked) for x in reversed(node.items) if not isinstance(x, str) and not x.skip)
    for node in reversed(order):
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body_share = root.link_chars / max(1, root.chars)
    for node in order:
        if node.chars:
            plain = max(1, node.chars - node.link_chars)
            base = math.log(node.chars / plain * node.link_chars + body_share * node.chars + math.e)
            ratio = node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)
            node.density = node.chars / max(1, node.tags) * max(0.0, math.log(ratio) / math.log(base) if base > 1 else math.log(ratio))
    for node in order:
        if node.parent is not None and node.tag in BLOCK:
            node.parent.sum += node.density
    return order


def article(root: Node, share: float = 0.2) -> Node:
    """The subtree of the largest density sum, or the smallest around it that holds all that belongs to it: subtrees beside
    its path to the body whose dense blocks, as dense as the sparsest node of that path, have `share` of its plain characters."""
    order = _measure(root)
    best = max(order, key=lambda n: n.sum if n.sum else n.density * 1e-9)
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min((n.density for n in path if n.tag != "html"), default=0.0)
    least = share * (best.chars - best.link_chars)
    joins = {id(n): i for i, n in enumerate(path)}
    beside: dict[int, tuple[int, int, bool]] = {}  # where a node's way up meets the path, below which child, whether in a dense block
    mass = [0] * len(order)
    height = 0
    for k, node in enumerate(order):  # parents come first
        if id(node) in joins:
            continue
        up = id(node.parent)
        at, child, counted = (joins[up], k, False) if up in joins else beside[up]
        if not counted and node.tag in BLOCK and node.density >= threshold > 0:
            counted = True
            mass[child] += node.chars - node.link_chars
            if mass[child] >= least:
                height = max(height, at)
        beside[id(node)] = (at, child, counted)
    return path[height]


def blocks(node: Node) -> list[str]:
    """The text of each block in page order, references decoded, white space as one space."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is end:
            end()
        elif isinstance(x, str):
            run.append(unescape(x))
        elif not x.skip:
            if x.tag == "br":
                run.append(" ")
            block = x.tag in BLOCK
            if block:
                end()
                stack.append(end)
            stack.extend(reversed(x.items))
    end()
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    return "\n\n".join(blocks(article(parse(html)))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
