"""Main text of web pages by composite text density.

A page becomes a small tree of nodes without scripts, styles, controls and hidden
parts. Elements and class names that speak of menus, sidebars, adverts, notices,
forms or reader comments *weigh* text down; a node so marked goes only if the
page has more text outside of it than its own weighs, so a wrapper whose class
happens to name a sidebar stays.

For every node left the link-adjusted characters per tag are computed, and a
node's density sum is the sum over its children. The threshold is the smallest
density on the path from the body to the densest node; among the nodes that reach
it, the subtree with the largest density sum is the heart of the article, on
every page and whatever its elements are called. It grows by what stands beside it
as long as that is short, or as dense and as free of links. Its blocks are the
text, in page order.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

# Element names of the HTML standard, by what they mean here.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROPPED = frozenset(
    "script style noscript template head title iframe object embed canvas svg math audio video map button select option textarea input noembed noframes xmp nav footer".split()
)
_WEIGHED = {"aside": 2, "dialog": 2, "menu": 2, "form": 1, "fieldset": 1, "label": 1}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body caption dd dt figcaption html legend li summary tbody td tfoot th thead tr".split())
#: An open element of the value, up to the nearest of the fences, ends where the key begins.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
# Words in class, id and role: of what isn't article, of what is, and those that say a part is there, not that this is it.
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion banner sidebar side aside rail nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar skip "
    "comment comments commentlist disqus respond replies reply discussion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "share sharing social related recommended recommendations recommend popular trending widget widgets pagination pager tags taglist hidden contentinfo complementary search".split()
)
_ARTICLE = frozenset("article body col column content entry main page post story text".split())
_ABOUT = frozenset("no non not has have with without show hide is enabled disabled xs sm md lg xl mobile desktop tablet print".split())
_PROTECTED = frozenset(("html", "body"))
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|$)|<[!?/][^>]*(?:>|$)", re.S)
_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?=[\s/]|$))", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    """An element: its children are nodes and pieces of text. ``mark``: how strongly
    its names say that it isn't article, from 0 to 2."""

    __slots__ = ("tag", "mark", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "weight")

    def __init__(self, tag: str, parent: Node | None, mark: int = 0) -> None:
        self.tag, self.parent, self.mark, self.children = tag, parent, mark, []


def _name_mark(value: str) -> int:
    """What the names in a class, an id or a role say: 2 for the name of a part that
    isn't article, 1 for a name that holds such a word, less for names of the article."""
    mark = 0
    for name in value.split():
        parts = [w.lower() for w in _PARTS.split(name) if w]
        if not parts or not _ABOUT.isdisjoint(parts):
            mark -= any(w in _ARTICLE for w in parts)
        elif parts[-1] in _NOISE:
            mark += 2
        elif parts[-1] in _ARTICLE and _NOISE.isdisjoint(parts):
            mark -= 1
        elif not _NOISE.isdisjoint(parts):
            mark += 1
    return mark


def _mark(tag: str, attrs: str) -> int:
    """Of an element: from 0 to 2, or -1 if it is no text of the page at all."""
    if tag in _DROPPED:
        return -1
    mark = _WEIGHED.get(tag, 0)
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN_STYLE.search(value)):
            return mark if tag in _PROTECTED else -1
        if name in ("class", "id", "role") and tag not in _PROTECTED:
            mark += _name_mark(value)
    return min(max(mark, 0), 2)


def parse(page: str) -> Node:
    """The tree of a page without scripts, controls and hidden parts. Never fails: unclosed and
    stray tags are closed or skipped much as browsers do."""
    root = Node("html", None)
    stack = [root]
    skip = 0  # depth of the stack at which dropped content began, 0: none
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not skip:
            stack[-1].children.append(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, attrs = m[2].lower(), m[3] or ""
        if m[1]:
            if tag == "p" and all(n.tag != "p" for n in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in _BLOCK and stack[i].tag in _BLOCK:
                    break  # an inline end tag doesn't close a block
            if skip and len(stack) <= skip:
                skip = 0
            continue
        if tag in ("html", "body") and any(n.tag == "body" for n in stack):
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in _BLOCK:
                    break
        if tag in _SIBLINGS:
            ends, fences = _SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in fences:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
        if tag == "body":  # an unclosed head ends here
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "head":
                    del stack[i:]
        if skip and len(stack) <= skip:
            skip = 0
        if tag == "html":
            continue
        mark = 0 if skip else _mark(tag, attrs)
        node = Node(tag, stack[-1], mark)
        if not skip:
            if mark < 0:
                if tag in _BLOCK:
                    stack[-1].children.append(Node("hr", stack[-1]))  # still parts the text around it
                if tag not in _VOID and not attrs.endswith("/"):
                    skip = len(stack)
            else:
                stack[-1].children.append(node)
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            skip = 0 if skip == len(stack) else skip
            continue
        stack.append(node)
    return root


def _below(root: Node) -> list[Node]:
    """The node and all below it, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    return order


def prune(root: Node) -> None:
    """Take out marked nodes: those whose text, a quarter of it for each point of the
    mark, is outweighed by the text outside of them. Texts of links don't count."""
    order = _below(root)
    for node in reversed(order):
        text = 0.0 if node.tag == "a" else float(sum(len(c.strip()) if isinstance(c, str) else c.weight for c in node.children))
        node.total = text
        node.weight = text / 4**node.mark
    outside: dict[int, float] = {id(root): 0.0}
    for node in order:
        if id(node) not in outside:
            continue  # below one that is taken out
        kept: list[Node | str] = []
        for c in node.children:
            if isinstance(c, Node):
                around = outside[id(node)] + node.total - c.weight
                if c.mark and c.weight < around:
                    if c.tag in _BLOCK:
                        kept.append(Node("hr", node))
                        outside[id(kept[-1])] = 0.0
                    continue
                outside[id(c)] = around
            kept.append(c)
        node.children = kept


def _measure(root: Node) -> None:
    """Characters, tags, link characters and link tags below each node, bottom up."""
    order = _below(root)
    for node in reversed(order):
        chars = tags = links = link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                chars += len(_SPACE.sub(" ", c).strip())
            else:
                chars, tags, links, link_tags = chars + c.chars, tags + c.tags + 1, links + c.link_chars, link_tags + c.link_tags
                link_tags += c.tag == "a"
        node.chars, node.tags, node.link_tags = chars, tags, link_tags
        node.link_chars = chars if node.tag == "a" else links
    body_links, body_chars = root.link_chars, max(1, root.chars)
    for node in order:
        node.density = _density(node, body_links / body_chars)
    for node in order:
        node.total = sum(c.density if isinstance(c, Node) else 0.0 for c in node.children)
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.total += own  # text right inside a node has no tag of its own


def _density(node: Node, body_share: float) -> float:
    """Composite text density: characters per tag, scaled down by the share of links."""
    if not node.chars:
        return 0.0
    chars, tags = node.chars, max(1, node.tags)
    links, link_tags = max(1, node.link_chars), max(1, node.link_tags)
    base = math.log(chars / max(1, chars - node.link_chars) * node.link_chars + body_share * chars + math.e)
    ratio = chars / links * tags / link_tags
    return chars / tags * max(0.0, math.log(max(ratio, 1e-9)) / base)


def main_node(root: Node) -> Node:
    """The subtree that is the article."""
    _measure(root)
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    blocks = [n for n in nodes if n.tag in _BLOCK and n.chars]
    if not blocks:
        return root
    densest = max(blocks, key=lambda n: n.density)
    threshold, node = densest.density, densest
    while node is not None:
        if node.tag in _BLOCK:
            threshold = min(threshold, node.density)
        node = node.parent
    best = max((n for n in blocks if n.density >= threshold), key=lambda n: n.total)
    # What stands beside it belongs to the article if it is short, or as dense and as free of links.
    node = best
    while node.parent is not None and node.tag not in ("body", "html"):
        beside = [c for c in node.parent.children if isinstance(c, Node) and c is not node and c.chars and not _is_link_list(c)]
        text = max(1, node.chars - node.link_chars)
        large = [c for c in beside if 5 * (c.chars - c.link_chars) > text]
        alike = all(c.density >= threshold / 2 and c.link_chars <= 0.3 * c.chars for c in large)
        if not alike and node.parent.chars - node.parent.link_chars > 1.5 * text:
            break
        if not large and node.tag in ("article", "main"):
            break  # weighs against taking in what is short
        node = node.parent
    for here in (node, best):  # lists of links beside the text are menus
        rest = [c for c in here.children if isinstance(c, str) or not _is_link_list(c)]
        here.children = rest if any(isinstance(c, str) and c.strip() or isinstance(c, Node) and c.chars for c in rest) else here.children
    if node.tag in ("body", "html"):  # a header right here is the page's
        rest = [c for c in node.children if isinstance(c, str) or c.tag != "header"]
        node.children = rest if any(isinstance(c, Node) and c.chars for c in rest) else node.children
    return node


def _is_link_list(node: Node) -> bool:
    return node.link_tags + (node.tag == "a") > 1 and node.link_chars > 0.7 * node.chars


def blocks_of(node: Node) -> list[str]:
    """The text of each block below a node, white space made one, empty ones left out."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        one = todo.pop()
        if one is None:
            close()
        elif isinstance(one, str):
            held.append(one)
        elif one.tag == "br":
            held.append(" ")
        elif one.tag in _BLOCK:
            close()
            todo.append(None)
            todo += reversed(one.children)
        else:
            todo += reversed(one.children)
    close()
    return out


def main_text(page: str | None) -> str:
    """The article of a page; an empty string if there is none."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n\n".join(blocks_of(main_node(root)))


def extracted(page: Column) -> Column:
    """The main text of a column of pages."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            held = pa.RecordBatch.from_arrays([batch], ["html"])
            yield pa.array([main_text(t) for part in slices(held, "html") for t in part.column(0).to_pylist()], pa.string())

    return run(page)


def page_texts(pages: DataFrame) -> DataFrame:
    """Per page page_id, url, text and n_chars (code points of the text).

    Null, empty and text-free pages give an empty text; broken markup is read much
    as browsers do; of equally dense subtrees the first counts; repeated rows are
    read each alone; an empty table gives no rows; other columns are left out.
    """
    out = pages.select("page_id", "url", extracted(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
