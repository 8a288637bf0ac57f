"""Main text of web pages, by tree scoring.

The page is read into a tree that tolerates unclosed and misnested tags. Subtrees that are not content by tag, role or class name (menus, headers
and footers of the page, sidebars, notices, adverts, forms, scripts, comments of readers) are left out; but a form, a header or a subtree with such a class name stays if it holds
the page: if it has the most text without links of them, and at most a tenth of that lies outside of them all. Every paragraph passes points to its
ancestors: one, one for each comma, and up to three for length; whole to the parent, half to the grandparent, less further up. A container's
points are discounted by the share of its text that is link text. The best container is kept, and with it all that lies beside it on each level up to the
article, the main part or the body, whatever its tag, length or points, without blocks and runs of text that are mostly links. Their blocks are the text.

Null html is empty, as is a page without text. Pages are read whole, very long and broken ones too, in linear time but for lists that are nested deeply. Repeated rows are extracted
each. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodeglass.llm.arrow import frugal

SCHEMA = "page_id long, url string, text string, n_chars long"
LINK_SHARE, OUTSIDE, LEAST = 0.5, 0.1, 140

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|object|svg|math|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>|</[^>]*+>",
    re.S | re.I,
)
_CLOSED = re.compile(r"(?:-->|</[a-z]+\s*>)\Z", re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_DROP_TAG = frozenset("nav footer aside button dialog menu head input audio video canvas map".split())
_DOUBT_TAG = frozenset("form fieldset label".split())
_READERS = re.compile(r"comment|discussion|disqus|respond|replies", re.I)
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
_DROP_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|menus?|nav\w*|breadcrumbs?|sidebars?|side|aside|widgets?|related|recommended|share|sharing|social|comments?|commentlist|discussion|disqus|respond|replies|footer|foot|masthead|subscribe|newsletter|login|signup|search|pagination|pager|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
_CLOSES_P = _BLOCK - {"html", "body"}
_PARAGRAPH = frozenset("p pre td blockquote li dd".split())
#: A start tag closes these open tags, up to the nearest of the second set.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "doubt", "inner", "links", "points")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, doubt: int = 0):
        self.tag, self.parent, self.dropped, self.doubt = tag, parent, dropped, doubt
        self.items: list[Node | str] = []
        self.inner = self.links = 0
        self.points = 0.0


def _judged(tag: str, raw: str, inside_article: bool) -> tuple[bool, int]:
    """(whether a subtree is no content for sure, whether it is none unless it holds the page: 1, or 2 for comments of readers)."""
    if tag in _DROP_TAG:
        return True, 0
    doubt = int(tag in _DOUBT_TAG or (tag == "header" and not inside_article))
    if not raw or tag in ("html", "body", "article", "main"):
        return False, doubt
    for name, a, b, c in _ATTR.findall(raw):
        name, value = name.lower(), (a or b or c).strip().lower()
        if name == "role" and value in _DROP_ROLE or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, 0
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True, 0
        if name in ("class", "id") and _DROP_NAME.search(value):
            doubt = max(doubt, 2 if _READERS.search(value) else 1)
    return False, doubt


def parse(page: str) -> Node:
    """The tree of a page, texts with character references decoded."""
    root = node = Node("#root", None, False)
    open_tags: dict[str, int] = {}
    at = 0

    def close(to: Node) -> Node:
        """Closes everything up to and with `to`."""
        now = node
        while True:
            open_tags[now.tag] -= 1
            if now is to:
                return now.parent
            now = now.parent

    last = page.rfind(">") + 1  # after it no tag ends
    for m in _TAG.finditer(page, 0, last):
        if m.start() > at:
            node.items.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if at == last and (m[1] or m[0].startswith("<!--")) and not _CLOSED.search(page, max(m.start(), last - 40), last):
            at = len(page)  # a comment or a script that never ends
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing, raw = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if closing:
            if open_tags.get(tag):
                target = node
                while target.tag != tag:
                    target = target.parent
                node = close(target)
            elif tag == "br":
                node.items.append(" ")
            continue
        if tag in _VOID:
            node.items.append(Node(tag, node, False) if tag == "hr" else " " if tag == "br" else "")
            continue
        if tag in _CLOSES_P and open_tags.get("p"):
            target = node
            while target.tag != "p":
                target = target.parent
            node = close(target)
        if tag in _IMPLIED:
            ends, stops = _IMPLIED[tag]
            if any(open_tags.get(x) for x in ends):
                target, last = node, None
                while target is not root and target.tag not in stops:
                    last = target if target.tag in ends else last
                    target = target.parent
                node = close(last) if last else node
        gone, doubt = _judged(tag, raw, bool(open_tags.get("article") or open_tags.get("main")))
        child = Node(tag, node, node.dropped or gone, doubt)
        node.items.append(child)
        if not raw.endswith("/") or tag not in ("path", "g"):
            node = child
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page):
        node.items.append(entities.unescape(page[at:]))
    return root


def _ordered(root: Node) -> list[Node]:
    """All nodes that are not dropped, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.dropped]
    return out


def _measure(nodes: list[Node]) -> None:
    """Text and link text of each subtree; `nodes`: parents before children."""
    for node in reversed(nodes):
        own = sum(len(" ".join(x.split())) for x in node.items if isinstance(x, str))
        kids = [x for x in node.items if isinstance(x, Node) and not x.dropped]
        node.inner = own + sum(x.inner for x in kids)
        node.links = node.inner if node.tag == "a" else sum(x.links for x in kids)


def _settle(top: Node) -> None:
    """Drops the subtrees in doubt, but the one that holds the page, if any; then what is in doubt within it."""
    doubted, stack = [], [top]
    while stack:
        for x in stack.pop().items:
            if isinstance(x, Node) and not x.dropped:
                (doubted if x.doubt else stack).append(x)
    outside = top.inner - top.links - sum(x.inner - x.links for x in doubted)
    kept = None
    for x in sorted(doubted, key=lambda x: (x.doubt, x.links - x.inner)):
        size = x.inner - x.links
        if kept is None and size >= LEAST and outside <= OUTSIDE * size and (x.doubt < 2 or outside < LEAST):
            kept = x
        else:
            x.dropped = True
    if kept:
        _settle(kept)


def _score(nodes: list[Node]) -> None:
    _measure(nodes)
    for node in nodes:
        direct = sum(len(x.split()) > 0 for x in node.items if isinstance(x, str))
        if not node.inner or not (node.tag in _PARAGRAPH or node.tag in ("div", "section", "article") and direct):
            continue
        commas = sum(x.count(",") + x.count("、") + x.count("，") for part in _texts(node) for x in [part])
        points = (1 + commas + min(node.inner // 100, 3)) * (1 - node.links / node.inner)
        up, level = node if node.tag in ("div", "section", "article") else node.parent, 0
        while up is not None and level < 5:
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1


def _texts(node: Node) -> Iterator[str]:
    """Texts directly in `node` or in inline tags within it."""
    stack = list(reversed(node.items))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif not x.dropped and x.tag not in _BLOCK:
            stack += reversed(x.items)


def blocks(chosen: list[Node]) -> list[str]:
    """Texts between block borders of the chosen subtrees, in page order, white space made single."""
    out: list[str] = []
    run: list[str] = []

    def end():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    for top in chosen:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                run.append(x)
            elif not x.dropped:
                if x.tag in _BLOCK:
                    end()
                    stack.append(None)
                stack += reversed(x.items)
        end()
    return out


def _leave_links(node: Node, keep: Node) -> None:
    """Takes the blocks, and the runs of texts and inline tags between blocks, that are mostly links from the items of `node`, but not `keep`."""
    items, run = [], []

    def end():
        size = links = 0
        for x in run:
            if isinstance(x, str):
                size += len(" ".join(x.split()))
            elif not x.dropped:
                size, links = size + x.inner, links + x.links
        if links <= LINK_SHARE * size:
            items.extend(run)
        run.clear()

    for x in node.items:
        if isinstance(x, str) or x is not keep and x.tag not in _BLOCK:
            run.append(x)
            continue
        end()
        if x is keep or x.dropped or x.links <= LINK_SHARE * x.inner:
            items.append(x)
    end()
    node.items = items


def main_text(page: str) -> str:
    root = parse(page)
    _measure(_ordered(root))
    _settle(root)
    nodes = _ordered(root)
    _score(nodes)
    value = lambda n: n.points * (1 - n.links / n.inner) if n.inner else 0.0
    best = max(nodes, key=value)
    if value(best) <= 0:
        return "\n".join(blocks([root]))
    while best.parent is not None and best.tag not in _BLOCK:
        best = best.parent
    top = best
    while top.parent is not None and top.tag not in ("body", "html", "article", "main"):
        _leave_links(top.parent, top)
        top = top.parent
    return "\n".join(blocks([top]))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page, as in `SCHEMA`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in frugal(batches):
            texts = [main_text(x.as_py() or "") for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages[id_col].cast("long"), pages[url], pages[html]).mapInArrow(task, SCHEMA)
