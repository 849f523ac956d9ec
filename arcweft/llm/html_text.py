"""Main text of web pages by tree scoring.

A small tolerant parser builds the element tree.  Paragraph-like elements pass points (one, plus one a comma, plus
length) to their ancestors, halved at each level up and discounted by the share of text inside links.  The article or
main around the best container is kept, or without one the container and its siblings; page furniture and, among
siblings, lists of links are dropped.

Defined cases: null or empty html gives an empty text; a page without a container gives the text of its body
without furniture; repeated pages are handled row by row; extra columns are passed on, but for those named like the
operator's own in any case of letters, which are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweft.llm.common import batches, kept_columns, strings, tidy

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "label", "fieldset", "head", "svg", "object", "applet", "template", "audio", "video", "canvas"} | RAW
BLOCKS = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br", *FURNITURE,
}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd", "h2", "h3", "h4"}
ENDS_P = BLOCKS - {"br"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"table", "ul", "ol", "dl", "article", "section", "main", "div", "body", "html", "td", "th", "blockquote"}
# Words in class, id or role that mark page furniture, and the article.
AWAY = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie",
    "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination",
    "popup", "promo", "promoted", "related", "remark", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "tags", "toolbar", "widget", "disclaimer", "alert", "complementary", "discussion", "legal", "copyright", "toc",
}
TOWARDS = {"article", "body", "content", "entry", "main", "page", "post", "story", "text"}
#: From this share of text in links on an element is a list of links.
LINKED = 0.25
#: Characters outside links from which a text is not small.
SMALL = 250
WEIGHT = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 2.0, "body": 0.0, "td": 1.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}


class Node:
    __slots__ = ("children", "furniture", "links", "marks", "name", "parent", "score", "size", "worded")

    def __init__(self, name: str, parent: Node | None, marks: int = 0, furniture: bool = False):
        self.name, self.parent, self.marks, self.furniture = name, parent, marks, furniture
        self.children: list[Node | str] = []
        self.score, self.size, self.links = 0.0, 0, 0
        self.worded = False


def _marks(attributes: str) -> tuple[int, bool, bool]:
    """Whether class and id speak for the article (1), whether their words mark furniture, and whether it is hidden."""
    good, away, hidden = 0, False, False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden":
            hidden = True
        elif key == "style":
            hidden = hidden or bool(_HIDDEN.search(value))
        elif key in ("class", "id", "role"):
            parts = {x.lower() for x in _PART.findall(value)}
            away = away or bool(parts & AWAY)
            good = good or int(bool(parts & TOWARDS))
    return good, away, hidden


def _release(root: Node) -> None:
    """Take the mark from elements that only words call furniture, where they hold the article.

    That is the largest article or main without such words; where there is none of size, most of the page's text outside
    links, if that is not small or is all there is.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.furniture and not node.worded:
            continue
        order.append(node)
        stack += [x for x in node.children if not isinstance(x, str)]
    amount: dict[int, int] = {}
    for node in reversed(order):
        n = sum(len(x.strip()) if isinstance(x, str) else amount.get(id(x), 0) for x in node.children)
        amount[id(node)] = 0 if node.name == "a" else n
    articles = [x for x in order if x.name in ("article", "main") and not x.worded]
    up = largest = max(articles, key=lambda x: amount[id(x)], default=None)
    found = amount[id(largest)] if largest else 0
    while up and found:
        if up.worded:
            up.furniture = False
        up = up.parent
    total = amount[id(root)]
    if found < SMALL:
        for node in order:
            n = amount[id(node)]
            if node.worded and 2 * n > total and (n >= SMALL or n == total):
                node.furniture = False


def parse(page: str) -> Node:
    """The element tree; unclosed and stray tags are handled the way browsers do for common cases."""
    at = root = Node("html", None)
    worded = False
    position, n = 0, len(page)
    while position < n:
        found = _TOKEN.search(page, position)
        if not found:
            at.children.append(page[position:])
            break
        if found.start() > position:
            at.children.append(page[position : found.start()])
        position = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name = name.lower()
        if found[1] or found[4]:
            up = at
            while up and up.name != name and not (name not in BLOCKS and up.name in BLOCKS):
                up = up.parent
            if up and up.name == name and up.parent:
                at = up.parent
            continue
        if name in ("html", "body"):
            if name == "body":
                while at.parent:
                    at = at.parent
                body = Node("body", at)
                at.children.append(body)
                at = body
            continue
        if name in VOID:
            at.children.append("\n" if name in ("br", "hr") else "")
            if name in ("br", "hr"):
                at.children.append(Node("br", at))
            continue
        if name in ENDS_P or name in CLOSES:
            closes, up = ({"p"} if name in ENDS_P else set()) | CLOSES.get(name, set()), at
            while up.parent:
                if up.name in closes:
                    at = up.parent
                    if up.name == "p" or name in CLOSES and up.name == name:
                        break
                elif up.name in SCOPES:
                    break
                up = up.parent
        attributes = found[3] or found[6] or ""
        good, away, hidden = _marks(attributes) if attributes and attributes != "/" else (0, False, False)
        inner = name in ("article", "main")
        node = Node(name, at, good, name in FURNITURE or (away or hidden) and not inner)
        node.worded = away and not hidden and name not in FURNITURE
        worded = worded or node.worded
        at.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>|\Z", re.I).search(page, position)
            position = end.end()
        elif not attributes.endswith("/"):
            at = node
    if worded:
        _release(root)
    return root


def _measure(root: Node) -> list[Node]:
    """Sizes and link sizes of all kept elements, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.furniture:
            continue
        order.append(node)
        stack += [x for x in node.children if not isinstance(x, str)]
    order.reverse()
    for node in order:
        for x in node.children:
            if isinstance(x, str):
                node.size += len(x.split()) and len(x.strip())
            elif not x.furniture:
                node.size += x.size
                node.links += x.links
        if node.name == "a":
            node.links = node.size
    return order


def _own_text(node: Node) -> str:
    """Text of a paragraph with its inline elements, without that of inner blocks."""
    parts, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is node or x.name not in BLOCKS:
            stack += reversed(x.children)
    return "".join(parts)


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def best(root: Node) -> list[Node | str]:
    """The article or main around the container with most points, or without one the container and its siblings, in page order.

    Siblings made of links and furniture are left out.
    """
    scored: dict[int, Node] = {}
    for node in _measure(root):
        direct = node.name in ("div", "section", "article", "main", "body") and any(isinstance(x, str) and x.strip() for x in node.children)
        if node.name not in PARAGRAPHS and not direct:
            continue
        text = _own_text(node).strip()
        if not text:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - _density(node))
        up, share = (node if direct else node.parent), 1.0
        while up and share > 0.1:
            if id(up) not in scored:
                scored[id(up)] = up
                up.score += WEIGHT.get(up.name, 0.0) + 10.0 * up.marks
            up.score += points * share
            up, share = up.parent, share / 2
    if not scored:
        return [root]
    for node in scored.values():
        node.score *= 1 - _density(node)
    top = max(scored.values(), key=lambda x: (x.score, x.size))
    if not top.parent:
        return [top]
    # One long section may outscore the article around it.
    up = top
    while up and not (up.name == "article" and _density(up) < LINKED):
        up = up.parent
    if not up:
        up = top
        while up and not (up.name == "main" and _density(up) < LINKED):
            up = up.parent
    if up:
        return [up]
    return [x for x in top.parent.children if x is top or isinstance(x, str) or not x.furniture and _density(x) < LINKED]


def text_of(nodes: list[Node | str]) -> str:
    """Blocks in page order: character references decoded, white space as one space, joined by one space."""
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        if now and (text := " ".join(html.unescape("".join(now)).split())):
            blocks.append(text)
        now.clear()

    for top in nodes:
        stack: list[Node | str | None] = [top]
        while stack:
            x = stack.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                now.append(x)
            elif not x.furniture:
                if x.name in BLOCKS:
                    close()
                    stack.append(None)
                stack += reversed(x.children)
        close()
    return " ".join(blocks)


def main_text(page: str | None) -> str:
    """Main text of one page."""
    return text_of(best(parse(page))) if page else ""


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """pages with text and n_chars instead of the html; own columns of those names are replaced.  No shuffle."""
    kept = kept_columns(pages, html_column, "text", "n_chars")
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b in batches(batch, html_column):
                part = batch.slice(a, b - a)
                texts = [main_text(x) for x in strings(part.column(html_column))]
                columns = [part.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text", "n_chars"])

    return pages.select(*kept, F.col(html_column).cast("string").alias(html_column)).mapInArrow(run, schema)
