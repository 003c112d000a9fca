"""Main text of web pages by composite text density.

A page becomes a tree of elements.  Scripts, styles, forms and elements that are named as menus,
headers, footers, sidebars, notices, adverts or reader comments hold no text.  For each other node

    density = (C / T) * log(C / LC * T / LT, base ln(C / nLC * LC + LCb / Cb * C + e))

with C characters, T tags, LC and LT those in links, nLC characters outside links, b the body (all
at least 1): characters per tag, weighed down by links.  The node whose children's densities have
the largest sum holds the article.  The least density on its path to the body is the threshold by
which sections beside that path still belong to it; headings, lists and paragraphs beside it belong
to it unless they are mostly links.

Blocks are runs of text between block-level tags (and ``br``); white space inside a block becomes
one space, blocks are trimmed and joined by one space.

Edge cases: a null, empty or text-free page gives an empty text; plain text without tags is its own
main text; what stands directly in the body is held to the same threshold, bare text there counts; unclosed elements close where their parent does; a `<` that no `>` closes is text; very
long, deep or broken pages are parsed whole, in time that grows with their length;
repeated rows are handled each on their own; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"</?[a-zA-Z]|<[!?]")
_NAME_END = re.compile(r"[\s/>]")
_GREATER = re.compile(">")
_SPECIAL = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SECTIONS = frozenset("div section article main table tbody tr td center".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SKIP = frozenset("nav footer aside form button select option input textarea svg canvas object embed head menu dialog fieldset".split())
_NAMED = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
    "comment comments disqus cookie cookies consent notice notices popup modal newsletter subscribe social share sharing related login signup".split()
)
_HEADER = frozenset("header masthead topbar".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: A start tag of the first kind ends an open element of the second.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "a": {"a"}}
#: End tags of inline elements and paragraphs don't close these.
_CELLS = ("td", "th", "article", "main")
_KEEPS_P = _INLINE | {"br", "img", "wbr", "button", "select", "option", "script", "style", "noscript", "svg", "object", "embed", "input", "iframe", "canvas", "map", "area"}


class _Node:
    __slots__ = ("chars", "children", "density", "link_chars", "link_tags", "parent", "parts", "skip", "tag", "tags")

    def __init__(self, tag: str, parent: _Node | None, skip: bool):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.children: list[_Node] = []
        self.parts: list[_Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def _boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _SKIP or tag == "header" and not in_article:
        return True
    if not attrs or "=" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        names = re.split(r"[\s_\-]+", value)
        if m[1].lower() == "role":
            if value.strip() in _ROLES and not (in_article and value.strip() == "banner"):
                return True
        elif not _NAMED.isdisjoint(names) or not in_article and not _HEADER.isdisjoint(names):
            return True
    return False


class _Tags:
    """The tags of a page from left to right, in time that grows with its length alone.

    A `<` without a matching `>` is text.  What a search without success has passed is remembered, so
    that no stretch of the page is searched again by every tag that stays open.
    """

    def __init__(self, html: str):
        self.html = html
        self.near: dict[re.Pattern, int] = {}
        self.dead: set[int] = set()

    def _next(self, pattern: re.Pattern, pos: int) -> int:
        """Where the pattern is met first at or after pos, which never goes back."""
        at = self.near.get(pattern, -1)
        if at < pos:
            m = pattern.search(self.html, pos)
            at = self.near[pattern] = m.start() if m else len(self.html)
        return at

    def _close(self, pos: int) -> int:
        """The first > from pos that stands outside quotes, or -1."""
        html, met = self.html, []
        at = self._next(_SPECIAL, pos)
        while at < len(html) and at not in self.dead:
            if html[at] == ">":
                return at
            met.append(at)
            end = html.find(html[at], at + 1)
            if end < 0:
                break
            m = _SPECIAL.search(html, end + 1)
            at = m.start() if m else len(html)
        self.dead.update(met)
        return -1

    def find(self, pos: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closes, name, attributes) of the next tag; comments and declarations have no name."""
        html = self.html
        while m := _TAG.search(html, pos):
            start, pos = m.span()
            if html[pos - 1] in "!?":
                if html.startswith("<!--", start):
                    end = html.find("-->", start + 4)
                    return start, end + 3 if end >= 0 else len(html), False, "", ""
                end = self._next(_GREATER, pos)
                if end < len(html):
                    return start, end + 1, False, "", ""
                continue
            name = self._next(_NAME_END, pos)
            end = self._close(name) if name < len(html) else -1
            if end >= 0:
                return start, end + 1, html[start + 1] == "/", html[pos - 1 : name].lower(), html[name:end]
        return None


class _Open:
    """The open elements, with the places of each tag and of what stops a search."""

    def __init__(self, root: _Node):
        self.nodes: list[_Node] = []
        self.places: dict[str, list[int]] = {}
        #: Elements that are not inline, and those that are neither inline nor paragraphs.
        self.solid: list[int] = []
        self.walls: list[int] = []
        self.push(root)

    def push(self, node: _Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag not in _INLINE:
            self.solid.append(at)
            if node.tag != "p":
                self.walls.append(at)

    def last(self, *tags: str) -> int:
        """The place of the innermost element of these tags, or 0."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def cut(self, at: int) -> None:
        """Close the element at a place and all inside it; the root stays open."""
        while len(self.nodes) > max(at, 1):
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag not in _INLINE:
                self.solid.pop()
                if tag != "p":
                    self.walls.pop()


def parse(html: str) -> _Node:
    """The tree of a page's elements with the text between them."""
    root = _Node("body", None, False)
    tags, stack = _Tags(html), _Open(root)
    at = 0

    def text(upto: int) -> None:
        if upto > at and not stack.nodes[-1].skip:
            stack.nodes[-1].parts.append(unescape(html[at:upto]))

    while found := tags.find(at):
        start, end, closes, tag, attrs = found
        text(start)
        at = end
        if not tag:
            continue
        if closes:
            place = stack.last(tag)
            if place and not (tag in _INLINE or tag == "p") or place > stack.last(*_CELLS):
                stack.cut(place)
            continue
        if tag in ("html", "body"):
            if len(stack.nodes) > 1 and stack.nodes[1].tag == "head":
                stack.cut(1)
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            gt = html.find(">", close.start()) if close else -1
            at = gt + 1 if gt >= 0 else len(html)
            continue
        if tag not in _KEEPS_P and stack.nodes[stack.solid[-1]].tag == "p":
            stack.cut(stack.solid[-1])
        if tag in _ENDS:
            place = stack.last(*_ENDS[tag])
            if place and place >= stack.walls[-1]:
                stack.cut(place)
        if stack.nodes[-1].tag == "head" and tag not in ("meta", "link", "base"):
            stack.cut(len(stack.nodes) - 1)
        parent = stack.nodes[-1]
        node = _Node(tag, parent, parent.skip or _boilerplate(tag, attrs, stack.last("article", "main") > 0))
        parent.children.append(node)
        parent.parts.append(node)
        if tag not in _VOID and not attrs.endswith("/"):
            stack.push(node)
    text(len(html))
    return root


def _measure(root: _Node) -> list[_Node]:
    """Fill in the counts of every node that may hold text; children come before parents."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.skip:
            order.append(node)
            todo.extend(node.children)
    order.reverse()
    for node in order:
        own = sum(len(" ".join(p.split())) for p in node.parts if isinstance(p, str))
        link = node.tag == "a"
        kids = [c for c in node.children if not c.skip]
        node.chars = own + sum(c.chars for c in kids)
        node.tags = len(kids) + sum(c.tags for c in kids)
        node.link_chars = node.chars if link else sum(c.link_chars for c in kids)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in kids)
    share = max(1, root.link_chars) / max(1, root.chars)
    for node in order:
        if node.chars:
            c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            base = math.log(c / max(1, c - node.link_chars) * lc + share * c + math.e)
            node.density = c / t * math.log(max(c / lc * t / lt, 1.0000001)) / math.log(max(base, 1.0000001))
    return order


def _emit(node: _Node, out: list[str]) -> None:
    """The node's text in page order, with a mark wherever a block begins or ends."""
    todo: list[_Node | str] = [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif not item.skip:
            mark = ["\0"] if item.tag not in _INLINE else []
            todo.extend([*mark, *reversed(item.parts), *mark])


def _belongs(node: _Node, threshold: float) -> bool:
    """A sibling of the article's path: dense enough, or a heading, list or paragraph that is not mostly links."""
    if node.skip or not node.chars:
        return False
    return node.density >= threshold or node.tag not in _SECTIONS and 10 * node.link_chars <= 3 * node.chars


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    root = parse(html)
    order = _measure(root)
    if not root.chars:
        return ""
    sums = {id(n): sum(c.density for c in n.children if not c.skip) for n in order}
    best = max((n for n in order if n.chars), key=lambda n: (sums[id(n)], n.density))
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    on_path = {id(n) for n in path}
    threshold = min(n.density for n in path)
    chosen = {id(best)}
    for child, parent in zip(path[:-1], path[1:], strict=True):
        chosen |= {id(c) for c in parent.children if c is child or _belongs(c, threshold)}
    out: list[str] = []
    if best is root:
        _emit(best, out)
    else:
        top, todo = root, [root]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif id(node) in chosen and (node is best or id(node) not in on_path):
                _emit(node, out)
            elif node is top or id(node) in on_path:
                todo.extend(["\0", *(p for p in reversed(node.parts) if isinstance(p, str) or id(p) in chosen or id(p) in on_path), "\0"])
    blocks = (" ".join(b.split()) for b in "".join(out).split("\0"))
    return " ".join(b for b in blocks if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
