"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph gives points for its length and commas to its parent, and half of
them to its grandparent; a container's points are discounted by its link density. The best container and those of its
siblings that read like text are kept, and their blocks of text are joined in page order. Where the best container lies
in an ``article``, that element and the articles beside it are kept, else a ``main`` around it: the page's own marks go
before the points.

Runs in Spark tasks, one page at a time, in time that grows with the page's length alone. Defined cases: null or empty html gives an
empty text; broken markup is read as far as it goes (open paragraphs end at the next block, stray end tags are ignored, a
``<`` that begins no tag is text); an element named like a menu or notice counts as one unless it has ``LONG_TEXT`` characters
outside links and four times the text found without it, and those named like comments or adverts unless nothing else has text;
of the header of an article its headings are read; no text is cut or capped; other columns pass through, but for one called ``_main_text``, which gives way.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import small_batches

#: A comment, other markup, or a tag with its attributes; a tag whose attributes hold a "<" outside quotes is none. Nothing is tried twice.
TOKEN = re.compile(r"<!--|<!\[CDATA\[|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"'=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?")
SPACE = re.compile(r"\s+")
WHOLE = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "title", "select", "xmp"}  # their content is no text
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dd", "dt", "tr", "td", "th"}
NEVER = {"nav", "footer", "aside", "form", "button", "header", "menu", "dialog", "input", "label", "option"}
#: Parts of class names, ids and roles of what isn't the article; "no-sidebar" and the like say something else.
COMMENTS = {"comment", "comments", "disqus", "replies", "reply", "respond", "ad", "ads", "advert", "advertisement", "promo", "related", "sponsor", "sponsored"}
UNLIKELY = COMMENTS | {"banner", "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "footer", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "share", "sharing", "sidebar", "signup", "social", "subscribe", "tags", "toolbar", "widget"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
BEGUN = ("advert", "promo", "sponsor", "navig")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
STATES = {"no", "not", "has", "with", "without", "is"}
TEXT_LIKE = {"p", "ul", "ol", "dl", "table", "pre", "blockquote", "figure", "h1", "h2", "h3", "h4", "h5", "h6"}
LIKELY_ROOT = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What attributes say of an element.
COMMENT, UNLIKE, HIDDEN = 1, 2, 3
#: Characters of an element that is read in spite of its name.
LONG_TEXT = 400


class Node:
    __slots__ = ("block", "kids", "links", "mute", "named", "parent", "points", "shown", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, block: Node | None, shown: bool = True, named: int = 0, mute: bool = False):
        self.tag, self.parent, self.block = tag, parent, block  # block: the nearest element around it that isn't inline
        self.shown, self.named, self.mute = shown, named, mute  # mute: its own text isn't read
        self.kids: list[Node | str] = []
        self.points, self.size, self.links = 0.0, 0, 0

    def below(self) -> list[Node]:
        """Elements in it that are read."""
        return [k for k in self.kids if isinstance(k, Node) and k.shown and not k.named]


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree of a page, and the outermost elements that are named like menus, notices or comments.

    The open elements lie on a stack, with the places on it of each tag and of all blocks, so that no tag looks through them.
    """
    root = Node("#", None, None)
    stack, places, solid, named = [root], {}, [0], []

    def close(to: int) -> None:
        """Ends the open elements from that place on."""
        while len(stack) > to:
            places[stack.pop().tag].pop()
            if solid[-1] == len(stack):
                solid.pop()

    at = 0
    low = None
    while True:
        node = stack[-1]
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and node.shown and not node.mute:
            node.kids.append(html.unescape(text) if "&" in text else text)
        if not m:
            return root, named
        at = m.end()
        if m.group() in ("<!--", "<![CDATA["):
            mark = "-->" if m.group() == "<!--" else "]]>"
            end = page.find(mark, at)
            if mark == "]]>" and node.shown and not node.mute:
                node.kids.append(page[at : len(page) if end < 0 else end])
            at = len(page) if end < 0 else end + 3
            continue
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            # Stray end tags, and inline ones that would end a block around them, do nothing.
            if places.get(name) and not (name in INLINE and solid[-1] > places[name][-1]):
                close(places[name][-1])
            continue
        if name in ENDS_P and solid[-1]:
            up = stack[solid[-1]]
            if up.tag == "p" or (up.tag == name and name in ("li", "dd", "dt", "tr", "td", "th")):
                close(solid[-1])
        node, block, attrs = stack[-1], stack[solid[-1]], m.group(3)
        own_header = name == "header" and bool(places.get("article"))
        shown = node.shown and (name not in NEVER or own_header) and name not in WHOLE
        kind = _unlikely(attrs, name == "article") if shown and attrs and name not in ("html", "body", "main") else 0
        new = Node(name, node, block, shown and kind != HIDDEN, kind, (node.mute or own_header) and name not in HEADINGS)
        node.kids.append(new)
        if kind and not node.mute and new.shown:
            named.append(new)
        if name in WHOLE:
            low = page.lower() if low is None else low
            end = low.find(f"</{name}", at)
            at = len(page) if end < 0 else end
            if end >= 0 and (close_at := page.find(">", end)) >= 0:
                at = close_at + 1
        elif name not in VOID and not attrs.endswith("/"):
            places.setdefault(name, []).append(len(stack))
            if name not in INLINE:
                solid.append(len(stack))
            stack.append(new)


def _unlikely(attrs: str, article: bool) -> int:
    """HIDDEN where attributes hide an element, COMMENT or UNLIKE where they name it so, else 0."""
    found = 0
    for name, value in ATTRIBUTE.findall(attrs):
        name = name.lower()
        if name == "hidden":
            return HIDDEN
        if name == "role" and not article and value.strip("\"'").lower() in ROLES:
            found = found or UNLIKE
        if name in ("class", "id", "aria-label"):
            for token in value.strip("\"'").split():
                parts = {p.strip("0123456789") for p in f"{token}-{CAMEL.sub('-', token)}".lower().replace("_", "-").split("-")}
                if parts & STATES:
                    continue
                if parts & COMMENTS or any(p.startswith(BEGUN) for p in parts):
                    found = COMMENT
                elif parts & UNLIKELY and not article:
                    found = found or UNLIKE
    return found


def score(root: Node) -> None:
    """Points of paragraphs to parents and grandparents; sizes of text and of linked text from the leaves up."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.points, node.size, node.links = 0.0, 0, 0
        order.append(node)
        stack += node.below()
    for node in reversed(order):
        own = "".join(k for k in node.kids if isinstance(k, str))
        node.size += len(own.strip())
        if node.tag == "a":
            node.links = node.size
        paragraph = node.tag in ("p", "pre", "td", "blockquote")
        if node.size >= 25 and (paragraph or (own.strip() and node.tag not in INLINE)):
            points = 1 + own.count(",") + own.count("、") + min(node.size // 100, 3)
            first = node.block if paragraph else node
            if first is not None:
                first.points += points
                if first.block is not None:
                    first.block.points += points / 2
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links


def density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def kept(root: Node) -> list[Node]:
    """The best container and its siblings of text, in page order; an article or main element around it goes before."""
    best, most = root, 0.0
    stack = [root]
    while stack:
        node = stack.pop()
        stack += reversed(node.below())
        if node.tag not in INLINE and (x := node.points * (1 - density(node))) > most:
            best, most = node, x
    up = best
    while up is not None and up.tag not in LIKELY_ROOT:
        up = up.parent
    if up is not None:
        return [up] if up.tag == "main" else [k for k in up.parent.below() if k is up or (k.tag == "article" and k.size and density(k) < 0.5)]
    if most == 0.0:
        roots = []
        stack = [root]
        while stack:
            node = stack.pop()
            if node.tag in LIKELY_ROOT and node.size:
                roots.append(node)
            else:
                stack += reversed(node.below())
        return roots or [root]
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    out = []
    for k in best.parent.below():
        if k is best or (k.size and k.tag not in INLINE and density(k) < 0.33 and (k.tag in TEXT_LIKE or k.points * (1 - density(k)) >= 0.1 * most)):
            out.append(k)
    return out


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below node, in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if text := SPACE.sub(" ", "".join(line)).strip():
                out.append(text)
            line.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            flush()
        elif x.shown and not x.named:
            if x.tag == "br":
                line.append(" ")
            elif x.tag in INLINE:
                stack += reversed(x.kids)
            else:
                flush()
                stack.append(None)
                stack += reversed(x.kids)
    flush()
    return out


def _plain_size(node: Node) -> int:
    """Characters in node outside links."""
    size, stack = 0, [node]
    while stack:
        x = stack.pop()
        size += sum(len(k.strip()) for k in x.kids if isinstance(k, str))
        stack += [k for k in x.below() if k.tag != "a"]
    return size


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, named = parse(page)

    def read() -> str:
        score(root)
        return "\n".join(b for node in kept(root) for b in blocks(node))

    text = read()
    # A name speaks against an element, and far more text than all the rest of the page speaks for it.
    most, best = max(((_plain_size(x), i) for i, x in enumerate(named) if x.named == UNLIKE), default=(0, 0))
    if most >= max(LONG_TEXT, 4 * len(text)):
        named[best].named = 0
        text = read()
    if not text and named:
        for x in named:
            x.named = 0
        text = read()
    return text


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without its html, with ``_main_text``; other columns pass through."""
    small_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html_col, "_main_text")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keep].copy()
            out["_main_text"] = [main_text(x) for x in b[html_col]]
            yield out

    schema = pages.select(*keep).schema.add("_main_text", "string")
    return pages.select(*keep, html_col).mapInPandas(run, schema)
