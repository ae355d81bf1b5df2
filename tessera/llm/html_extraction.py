"""HTML extraction by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores by the elements it is in: each tag and each
word of a class, id or role has a weight, the log odds with which it holds words of the main text
in labelled pages. Tags between words cost a little. One linear scan finds the contiguous region
with the greatest sum. Words of notices or adverts inside an article score below zero and may cut
its heading or its end off the region, so the region is completed to the smallest element that
holds it; the text is the blocks of that element whose words score above zero.

Reading a page takes time in proportion to its length, however its elements nest: open elements are
a list with the positions of each tag in it, and scores are summed from the top down.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_REST = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_QUOTE_OR_END = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is not text of the page.
RAW = frozenset({"script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object", "canvas", "select", "title", "option", "audio", "video", "xmp", "noembed", "noframes"})
#: Elements that have no end tag.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
#: Elements that begin and end blocks.
BLOCKS = frozenset({"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "caption", "tr", "ul"})
#: Elements that are closed by the next of their kind, and the elements that stop the search for one to close.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: What a tag between words costs.
TAG_COST = 0.15
#: What a word scores without evidence, and the feature of blocks that are links.
PRIOR = 0.8
LINKED = "a:"
MOST = 3.0


@dataclass(eq=False, slots=True)
class Node:
    """An element. Its elements are those that begin from `begin` on and before `end`."""

    tag: str
    parent: Node | None
    features: tuple[str, ...] = ()
    hidden: bool = False
    begin: int = 0
    end: int = 1 << 62
    score: float = 0.0

    def holds(self, other: Node) -> bool:
        return self.begin <= other.begin < self.end


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    tags_before: int
    main: bool = False
    words: int = 0
    linked: bool = False  # nearly all of it is links


def _features(tag: str, attributes: str, hidden: bool) -> tuple[tuple[str, ...], bool]:
    """The features of an element's tag and attributes, and whether it is hidden."""
    features = ["t:" + tag]
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "aria-hidden" and value == "true" and tag != "a":
                hidden = True
            elif name in ("class", "id", "role"):
                features += ["c:" + w.lower() for w in _PART.findall(value)]
    return tuple(dict.fromkeys(features)), hidden


def next_tag(page: str, at: int) -> tuple[int, int, str | None, str] | None:
    """Where the next tag or comment begins and ends, its name (with / if it closes; null for comments) and attributes.

    A tag ends at the first > outside quotes; a quote that is never closed is a character like others. Markup that never ends
    is left out, as is all that follows it.
    """
    n = len(page)
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return at, n if end < 0 else end + 3, None, ""
        if name := _NAME.match(page, at + 1):
            found = _REST.match(page, name.end())
            end = found.end() if found else _tag_end(page, name.end())
            return at, end, name[0].lower(), page[name.end() : end - 1]
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            return at, n if end < 0 else end + 1, None, ""
        at += 1
    return None


def _tag_end(page: str, at: int) -> int:
    """The end of a tag with a quote that is never closed, or of the page. There are two kinds of quotes, so few tags come here."""
    while found := _QUOTE_OR_END.search(page, at):
        if found[0] == ">":
            return found.end()
        close = page.find(found[0], found.end())
        at = found.end() if close < 0 else close + 1
    return len(page)


@dataclass
class _Open:
    """The open elements, innermost last, with the positions of each tag, and of blocks, among them."""

    nodes: list[Node]
    of: dict[str, list[int]] = field(default_factory=dict)
    blocks: list[int] = field(default_factory=lambda: [0])
    count: int = 1

    def push(self, node: Node) -> None:
        node.begin = self.count
        self.count += 1
        self.of.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tag: str) -> int:
        held = self.of.get(tag)
        return held[-1] if held else 0

    def cut(self, position: int) -> None:
        """Closes the element at a position and all inside it; the top stays."""
        while len(self.nodes) > max(position, 1):
            node = self.nodes.pop()
            node.end = self.count
            self.of[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()

    def close_before(self, tag: str) -> None:
        """Closes what the begin of an element ends: the like of it that no element of its scope is inside of."""
        closes, scope = _CLOSES[tag], _SCOPE.get(tag)
        position = max(self.last(t) for t in closes)
        barrier = max(self.last(t) for t in scope) if scope else self.blocks[-1]
        if position and position >= barrier:
            while position > 1 and self.nodes[position - 1].tag in closes:
                position -= 1
            self.cut(position)


def blocks(page: str, weights: dict[str, float] | None = None, labelled: bool = False) -> Iterator[Block]:
    """The blocks of text of a page, in order; with weights, their elements' scores. In labelled pages `x-main` marks main text."""
    score = (lambda features: sum(weights.get(f, 0.0) for f in features)) if weights else (lambda features: 0.0)
    top = Node("html", None, ("t:html",))
    top.score = score(top.features) + (weights or {}).get("", 0.0)
    opened = _Open([top])
    at = before = main = 0
    parts: list[str] = []
    links = linked = 0

    def flush():
        nonlocal parts, before, linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        made = None
        if text:
            made = Block(opened.nodes[opened.blocks[-1]], text, before, main > 0, text.count(" ") + 1, linked > 0.8 * sum(map(len, parts)))
            before = 0
        parts, linked = [], 0
        return made

    while found := next_tag(page, at):
        begin, end, name, attributes = found
        if begin > at and not opened.nodes[-1].hidden:
            parts.append(page[at:begin])
            linked += (begin - at) * (links > 0)
        at = end
        if name is None:
            continue
        closing = name[0] == "/"
        tag = name[1:] if closing else name
        if labelled and tag == "x-main":
            if made := flush():
                yield made
            main += -1 if closing else 1
            continue
        before += 1
        if not closing and tag in RAW:
            if not (attributes.endswith("/") and tag in ("svg", "math")):
                stop = _end_of(tag).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if tag in BLOCKS:
            if made := flush():
                yield made
            links = 0
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        if tag in VOID:
            continue
        if closing:
            if position := opened.last(tag):
                opened.cut(position)
            continue
        if tag in BLOCKS and opened.nodes[-1].tag == "p":
            opened.cut(len(opened.nodes) - 1)
        if tag in _CLOSES:
            opened.close_before(tag)
        if tag == "html":
            continue
        if tag == "body":
            opened.cut(1)
        parent = opened.nodes[-1]
        features, hidden = _features(tag, attributes, parent.hidden)
        opened.push(Node(tag, parent, features, hidden, score=parent.score + score(features)))
    if at < len(page) and not opened.nodes[-1].hidden:
        parts.append(page[at:])
        linked += (len(page) - at) * (links > 0)
    if made := flush():
        yield made
    opened.cut(1)


@functools.cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def fit(labelled: list[str]) -> dict[str, float]:
    """Weights of features from pages in which `x-main` elements hold the main text: smoothed log odds, by page and block."""
    inside, outside = Counter(), Counter()
    n_in = n_out = 0.0
    for page in labelled:
        for b in blocks(page, labelled=True):
            w = math.log1p(b.words)
            features = {f for node in _path(b.node) for f in node.features} | ({LINKED} if b.linked else set())
            (inside if b.main else outside).update(dict.fromkeys(features, w))
            n_in, n_out = n_in + w * b.main, n_out + w * (not b.main)
    weights = {}
    for f in inside.keys() | outside.keys():
        odds = math.log((inside[f] + 0.5) / (n_in + 1)) - math.log((outside[f] + 0.5) / (n_out + 1))
        weights[f] = max(-MOST, min(1.0, odds))
    weights[""] = PRIOR
    return weights


def _block_score(b: Block, weights: dict[str, float]) -> float:
    return b.node.score + (weights.get(LINKED, 0.0) if b.linked else 0.0)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The range of the greatest sum of consecutive scores; empty if none is above zero. The first such range on ties."""
    best, at, begin, total = 0.0, (0, 0), 0, 0.0
    for i, s in enumerate(scores):
        if total <= 0:
            begin, total = i, 0.0
        total += s
        if total > best:
            best, at = total, (begin, i + 1)
    return at


def extract(page: str | None, weights: dict[str, float], complete: bool = True) -> str:
    """The main text of a page: its blocks, joined by empty lines. complete: of the region's element, or else of the region alone."""
    found = list(blocks(page or "", weights))
    each = [_block_score(b, weights) for b in found]
    scores = [max(-MOST, min(1.0, s)) * b.words - TAG_COST * min(b.tags_before, 10) for s, b in zip(each, found, strict=True)]
    begin, end = best_region(scores)
    if begin == end:
        return ""
    chosen = range(begin, end)
    if complete:
        whole = _container(found[begin].node)
        for b in found[begin + 1 : end]:
            while not whole.holds(b.node):
                whole = _container(whole.parent)
        chosen = [i for i, b in enumerate(found) if whole.holds(b.node)]
    return "\n\n".join(found[i].text for i in chosen if each[i] > 0)


def _container(node: Node) -> Node:
    """The nearest element that holds blocks rather than words."""
    while node.parent is not None and node.tag not in ("article", "main", "div", "section", "body", "td", "html"):
        node = node.parent
    return node


def extract_pages(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """Rows page_id, url, text, n_chars (code points), one for each page.

    pages: page_id, url, html; other columns don't matter. labelled: pages to take weights from, by default LABELLED. A null or
    empty html, and one without main text, gives an empty text. Repeated rows give repeated rows, and null ids and urls stay
    null. Broken markup is read as far as it goes; a page may be of any length. One pass, without a shuffle.
    """
    weights = fit(labelled) if labelled else default_weights()

    def emit(batches):
        for block in T.blocks(batches, "html", 8 << 20):
            texts = [extract(h, weights) for h in block.column("html").to_pylist()]
            yield pa.record_batch({"page_id": block.column("page_id"), "url": block.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(emit, "page_id long, url string, text string, n_chars long")


@functools.cache
def default_weights() -> dict[str, float]:
    from .labelled_pages import LABELLED

    return fit(LABELLED)
