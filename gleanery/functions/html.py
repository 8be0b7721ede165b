"""Texts out of web pages: a small parser, the selectors in use, and titles by keyword. Arrow batches, never single rows."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import CONTENT_TAGS, FALLBACK_TAGS, PRIORITY_KEYWORDS, SECONDARY_KEYWORDS, STOP_TAGS, TITLE_TAGS

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("step", T.StringType())])


#: Elements whose text isn't the page's; those that end an open paragraph; those that end an open one of the same list or table, and where it is looked for at most.
SILENT = frozenset(("script", "style", "template"))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"
))
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
HOLDERS = BLOCKS - {"p"} | {"li", "td", "th", "dd"}
WITHIN = frozenset(("ul", "ol", "dl", "select", "table"))


class Node:
    """place: among all children of the parent; nth: among its elements, from 1; count: elements among its own children."""

    __slots__ = ("tag", "attrs", "children", "parent", "place", "nth", "count")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent, self.count = tag, attrs, [], parent, 0
        if parent is not None:
            parent.count += 1
            self.place, self.nth = len(parent.children), parent.count
            parent.children.append(self)

    def elements(self):
        """Elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def strings(self):
        todo = list(reversed(self.children))
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                yield n
            elif n.tag not in SILENT:
                todo += reversed(n.children)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)

    def ended(self, tags, within):
        """Close the nearest open element of tags, if it lies below the nearest of within."""
        node = self.now
        while node.parent is not None and node.tag not in tags and node.tag not in within:
            node = node.parent
        if node.parent is not None and node.tag in tags:
            self.now = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.ended(("p",), HOLDERS)
        elif tag in ITEMS:
            self.ended(ITEMS[tag], WITHIN)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        Node(tag, {k: v or "" for k, v in attrs}, self.now)

    def handle_endtag(self, tag):
        node = self.now
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.now = node.parent

    def handle_data(self, data):
        self.now.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def normal(text: str | None) -> str:
    return re.sub(r"\s+", " ", (text or "").replace("​", "").replace(" ", " ")).strip()


def text_of(node: Node) -> str:
    """Strings below, each stripped, with single spaces between."""
    return normal(" ".join(s for s in (x.strip() for x in node.strings()) if s))


_PART = re.compile(r"([\w-]+|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:=['\"]?([^'\"\]]*)['\"]?)?\]|:nth-child\((\d+)\)")


def _fits(node: Node, compound: str) -> bool:
    at = 0
    while at < len(compound):
        m = _PART.match(compound, at)
        if not m:
            raise ValueError(f"selector not understood: {compound}")
        tag, ident, cls, name, value, nth = m.groups()
        if tag and tag not in ("*", node.tag):
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if name and (name not in node.attrs or (value is not None and node.attrs[name] != value)):
            return False
        if nth and node.nth != int(nth):
            return False
        at = m.end()
    return True


def _matches(node: Node, steps: list[str]) -> bool:
    if not _fits(node, steps[-1]):
        return False
    if len(steps) == 1:
        return True
    if steps[-2] == ">":
        return node.parent is not None and node.parent.tag != "" and _matches(node.parent, steps[:-2])
    up = node.parent
    while up is not None and up.tag:
        if _matches(up, steps[:-1]):
            return True
        up = up.parent
    return False


def select(root: Node, selector: str) -> list[Node]:
    """Tags, #id, .class, [attribute=value], :nth-child(n), descendants, children and lists of these."""
    ways = [re.sub(r"\s*>\s*", " > ", s).split() for s in selector.split(",") if s.strip()]
    return [n for n in root.elements() if any(_matches(n, w) for w in ways)]


def content_near(title: Node, block: Node | None, barren: dict[Node, int]) -> str:
    """Content elements after a title up to the next great heading; else block, the next one in the document. barren: up to which of a parent's
    children an earlier title found none, so that they aren't looked through again."""
    siblings, found = title.parent.children, []
    if title.place >= barren.get(title.parent, 0):
        i = title.place + 1
        while i < len(siblings):
            n = siblings[i]
            if not isinstance(n, str):
                if n.tag in STOP_TAGS:
                    break
                if n.tag in CONTENT_TAGS and (text := text_of(n)):
                    found.append(text)
            i += 1
        if found:
            return " ".join(found)
        barren[title.parent] = i
    return text_of(block) if block else ""


def by_keyword(root: Node, keywords) -> str:
    elements, barren = list(root.elements()), {}
    blocks: list[Node | None] = [None] * len(elements)
    for i in range(len(elements) - 2, -1, -1):
        blocks[i] = elements[i + 1] if elements[i + 1].tag in FALLBACK_TAGS else blocks[i + 1]
    for n, block in zip(elements, blocks, strict=True):
        if n.tag in TITLE_TAGS:
            title = " ".join(s for s in (x.strip() for x in n.strings()) if s).lower()
            if any(k in title for k in keywords) and (text := content_near(n, block, barren)):
                return text
    return ""


#: What the parser raises on pages that it can't read.
BROKEN = (ValueError, RecursionError, AssertionError)


def extract(html: str | None, selector: str | None, first=PRIORITY_KEYWORDS, second=SECONDARY_KEYWORDS) -> tuple[str, str]:
    """A page's text and the step that found it: selector, priority title, secondary title or none. Broken pages give none."""
    if not html:
        return "", "none"
    try:
        root = parse(html)
        if selector and selector.strip() not in ("", "-"):
            text = normal(" ".join(t for n in select(root, selector) if (t := text_of(n))))
            if text:
                return text, "selector"
        for step, words in (("priority", first), ("secondary", second)):
            if text := by_keyword(root, words):
                return text, step
    except BROKEN:
        return "", "none"
    return "", "none"


def whole_text(html: str | None) -> str:
    """A page's whole text; broken pages give none."""
    try:
        return text_of(parse(html)) if html else ""
    except BROKEN:
        return ""


def extractor(first=PRIORITY_KEYWORDS, second=SECONDARY_KEYWORDS):
    """A function of (html, selector) columns giving struct(text, step)."""

    @F.pandas_udf(SCHEMA)
    def f(html: pd.Series, selector: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(h, s, first, second) for h, s in zip(html, selector, strict=True)], columns=["text", "step"])

    return f


@F.pandas_udf(T.StringType())
def page_text(html: pd.Series) -> pd.Series:
    return html.map(whole_text)
