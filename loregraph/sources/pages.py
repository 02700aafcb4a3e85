"""Articles of stored web pages: a tree with implied end tags, the container that holds most of the text, and its lines.

A page that isn't well formed still gives a tree: an item ends the one before it in its list, a cell the one before it in its row, a block an
open paragraph, and an end tag without a start is left out. Navigation, asides, footers and advertisements are left out with all that they hold,
as are lists and boxes that are mostly links. If nothing is left of a page that has text, that text is given.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Kinds of elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"script", "style", "noscript", "template", "title", "head"}
ASIDE = {"nav", "aside", "footer"}
BOXES = {"div", "section", "table", "ul", "ol"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | {"p", "li", "blockquote", "td", "th", "pre", "div", "article", "section", "br", "main", "ul", "ol", "table", "tr", "dl", "dt", "dd", "header", "figure", "figcaption", "form", "address"}
PARAGRAPHS = {"p", "td", "pre", "blockquote"}
#: What a start tag ends, and where the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}),
}
LEAST_PARAGRAPH, LEAST_SHARE = 25, 0.5
MOST_LINKS, LEAST_LINKS = 0.5, 3

PAGE_SCHEMA = "page_id long, title string, text string, markdown string, headings array<string>, links array<string>, images array<string>, lang string, description string, canonical string"


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    parent: Node | None = None
    children: list = field(default_factory=list)
    #: Characters of text, of text in links, and the number of links below, without what is left out.
    chars: int = 0
    linked: int = 0
    links: int = 0
    longest: int = 0

    def aside(self) -> bool:
        return self.tag in ASIDE or "ad" in (self.attrs.get("class") or "").split()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")
        self.opened: Counter[str] = Counter()

    def _leave(self, node: Node) -> None:
        """End ``node`` and what is open in it."""
        while self.at is not node.parent:
            self.opened[self.at.tag] -= 1
            self.at = self.at.parent

    def _open(self, tags: set[str], stop: set[str]) -> Node | None:
        """The innermost open element of ``tags``, not beyond one of ``stop``."""
        node = self.at if any(self.opened[t] for t in tags) else None
        while node is not None and node.tag not in stop:
            if node.tag in tags:
                return node
            node = node.parent
        return None

    def handle_starttag(self, tag, attrs):
        tags, stop = ENDS.get(tag, (set(), set()))
        if tag in BLOCKS and tag != "br" and tag not in ENDS:
            tags, stop = {"p"} | (HEADINGS if tag in HEADINGS else set()), BLOCKS - {"p"} - HEADINGS
        if tags and (open_ := self._open(tags, stop)) is not None:
            self._leave(open_)
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.opened[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        inside_table = {"table"} if tag in ("td", "th", "tr", "thead", "tbody", "tfoot") else {"td", "th", "table"} if tag not in ("table", "body", "html") else set()
        node = self.at if self.at.tag == tag else self._open({tag}, inside_table - {tag})
        if node is not None and node is not self.root:
            self._leave(node)

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def events(top: Node, leave_out) -> Iterator[tuple[str, object]]:
    """("start", node), ("text", text) and ("end", node) of a tree in order, without the nodes that ``leave_out`` says. No recursion: pages nest deeply."""
    yield "start", top
    stack = [(top, iter(top.children))]
    while stack:
        node, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            yield "end", node
        elif isinstance(child, str):
            yield "text", child
        elif not leave_out(child):
            yield "start", child
            stack.append((child, iter(child.children)))


def _measure(top: Node, leave_out) -> None:
    depth = 0
    for kind, x in events(top, leave_out):
        if kind == "start":
            depth += x.tag == "a"
            at = x
            at.chars = at.linked = at.links = at.longest = 0
        elif kind == "text":
            n = len(" ".join(x.split()))
            at.chars += n
            at.linked += n if depth else 0
        else:
            depth -= x.tag == "a"
            if x.tag in PARAGRAPHS:
                x.longest = max(x.longest, x.chars - x.linked)
            if x is not top:
                at = x.parent
                at.chars, at.linked, at.links, at.longest = at.chars + x.chars, at.linked + x.linked, at.links + x.links + (x.tag == "a"), max(at.longest, x.longest)


def container(body: Node, leave_out) -> Node:
    """The element whose paragraphs make it most of an article, if it holds at least LEAST_SHARE of the text; else ``body``.

    A paragraph counts for its parent and half for the one above: 1, its commas, and a point for each 100 characters, 3 at most; links take
    their share away.
    """
    scores: dict[Node, float] = {}
    for kind, x in events(body, leave_out):
        if kind == "end" and x.tag in PARAGRAPHS and x is not body and x.chars >= LEAST_PARAGRAPH:
            commas = sum(c.count(",") for c in x.children if isinstance(c, str))
            own = 1 + commas + min(3, x.chars // 100)
            scores[x.parent] = scores.get(x.parent, 0) + own
            if x.parent is not body and x.parent.parent is not None:
                scores[x.parent.parent] = scores.get(x.parent.parent, 0) + own / 2
    ranked = {n: s * (1 - n.linked / max(1, n.chars)) for n, s in scores.items()}
    best = max(ranked, key=ranked.get, default=body)
    return best if best.chars >= LEAST_SHARE * body.chars else body


def _find(top: Node, tag: str) -> Node | None:
    return next((x for kind, x in events(top, lambda _: False) if kind == "start" and x.tag == tag), None)


def _lines(parts: list[str]) -> str:
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(parts).split("\n")) if x)


def render(top: Node, leave_out) -> dict:
    """Text, Markdown, headings, links and images of a tree."""
    parts, marked, headings, links, images, heading = [], [], [], [], [], None
    for kind, x in events(top, leave_out):
        if kind == "text":
            parts.append(x)
            marked.append(x)
            if heading is not None:
                heading.append(x)
            continue
        if x.tag in BLOCKS:
            parts.append("\n")
            marked.append("\n")
        if kind == "start":
            if x.tag == "a" and x.attrs.get("href"):
                links.append(x.attrs["href"])
            elif x.tag == "img" and x.attrs.get("src"):
                images.append(x.attrs["src"])
            elif x.tag == "li":
                marked.append("- ")
            elif x.tag in HEADINGS:
                marked.append("#" * int(x.tag[1]) + " ")
                heading = []
        elif x.tag in HEADINGS and heading is not None:
            headings.append(" ".join("".join(heading).split()))
            heading = None
    return {"text": _lines(parts), "markdown": _lines(marked), "headings": headings, "links": links, "images": images}


def extract_page(html: str | None) -> dict:
    root = parse(html or "")
    meta, lang, canonical = {}, None, None
    for kind, x in events(root, lambda _: False):
        if kind == "start":
            if x.tag == "html":
                lang = x.attrs.get("lang")
            elif x.tag == "meta":
                meta.setdefault(x.attrs.get("name") or x.attrs.get("property"), x.attrs.get("content"))
            elif x.tag == "link" and x.attrs.get("rel") == "canonical":
                canonical = x.attrs.get("href")
    named = _find(root, "title")
    title = " ".join("".join(c for c in named.children if isinstance(c, str)).split()) if named else ""
    first = lambda *names: next((meta[n] for n in names if meta.get(n)), None)

    unseen = lambda n: n.tag in UNSEEN
    aside = lambda n: unseen(n) or n.aside()
    body = _find(root, "body") or root
    _measure(body, aside)
    best = container(body, aside)
    boxes = lambda n: aside(n) or (n.tag in BOXES and n is not best and n.links >= LEAST_LINKS and n.linked > MOST_LINKS * n.chars and n.longest < LEAST_PARAGRAPH and 2 * n.chars < best.chars)
    out = render(best, boxes)
    if not out["text"]:
        out = render(root, unseen)
    return {"title": first("og:title", "twitter:title") or title, **out, "lang": lang, "description": first("description", "og:description", "twitter:description"), "canonical": canonical or first("og:url")}


def extract_pages(pages: DataFrame) -> DataFrame:
    """Article, Markdown and metadata of stored pages (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([{"page_id": i, **extract_page(h)} for i, h in zip(pdf["page_id"], pdf["html"], strict=True)], columns=[c.split()[0] for c in PAGE_SCHEMA.split(", ")])

    return pages.select("page_id", "html").mapInPandas(run, PAGE_SCHEMA)
