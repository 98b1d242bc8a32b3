"""Main text of pages by composite text density.

A page is read into a tree of block elements (inline elements add their text, links and tags
to the block around them; unclosed elements end where the next block or their parent does).
Subtrees that say what they are leave first, whatever their size: scripts, styles, forms, and by element,
role or a name in class or id: menus, page headers, footers, sidebars, notices, adverts, sharing bars and reader comments.
A name counts by its last word ("post-comments", but not "related-story" or "with-sidebar"), and names take
nothing away from a page that has no other text. What holds the page's ``article`` or ``main`` stays, and so do a form that
frames a page's parts and the header of an article that has its heading.

For each node: C characters, T tags, LC characters in links, LT link tags, over its subtree. With
NLC = C - LC and the body's LCb and Cb, its density is

    C / T * log(C / LC * T / LT) / log(log(C * LC / NLC + LCb / Cb * C + e))

(zero counts taken as 1, the last logarithm at least 0.1): characters per tag, adjusted for links. A
node's density sum adds its children's densities. The threshold is the least density on the path
to the node of the largest sum: with the body for subtrees of prose (a paragraph, or several blocks of
text), without it for single blocks, such as a bare notice. Under every node that reaches it the node of
the largest sum is main text, and so are paragraphs and headings beside it. The topmost ``article`` and ``main`` elements
with text are the main text as a whole where they hold half of what the densities found or more; else, as teasers, they
stay beside it.

In a tag a quote opens a value only right behind ``=``, as in ``title="a > b"``; elsewhere, as in
``title=don't``, it is a letter like any other, and so is one that nothing closes.

Blocks of text in page order, white space as one space, are joined by a blank line.

Defined cases: a null or empty page, or one without text, has empty text; a page that is cut reads as
if its elements ended; equal pages have equal texts; of equal sums the outermost, then first, counts; very long pages are read whole; an
empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import bounded_batches

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr nobr".split())
#: Elements that end an open element of the second set.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead"}, "option": {"option"},
}
#: What bounds the search for an element to end.
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "option": {"select"}}
#: Elements of one block of text.
BLOCKS = set("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
DROPPED = set("head nav header footer aside form menu dialog button select input fieldset svg math canvas audio video object embed iframe noscript template script style title textarea".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or id that name what is no main text.
NAMES = set(
    "ad ads adv advert adverts advertisement advertisements adbox adslot adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toc skip masthead topbar header footer foot colophon copyright "
    "sidebar sidebars aside widget widgets related recommended recommendations trending share sharing social "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe signup login search form "
    "comment comments commentlist commentary discussion disqus replies reply respond feedback".split()
)
COMMENT = {"comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond"}
#: Words that, at its end, make a name that of a state or of something else: "comments-open", "related-story"; and before it: "with-sidebar".
FRAMES = set("open opened closed enabled disabled on off ready page site body layout wrapper wrap container content main inner outer story post article entry text".split())
HAVING = set("with has have no without".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that a page has and a form of it has not.
FRAME = {"article", "main", "nav", "header", "footer", "aside", "section", "h1"}

#: A value behind the equals sign of an attribute.
_VALUE = r"(?:\"[^\"]*\"|'[^']*'|[^\s>]*+)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+{_VALUE})*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
#: What ends a raw element; nothing else inside it is a token.
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*+)))?", re.S)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "parent", "parts", "boilerplate", "comment", "role", "chars", "tags", "link_chars", "link_tags", "density", "sum", "main")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        #: Texts and child nodes in order.
        self.parts: list[str | Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.main = False
        #: Whether a class or id names it as no main text, and as comments.
        self.boilerplate = self.comment = False
        self.role = ""
        if attributes.strip():
            for key, *values in ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "")
                if key.lower() == "role":
                    self.role = value.lower()
                elif key.lower() in ("class", "id"):
                    for name in value.split():
                        words = [w.lower() for w in WORD.findall(name)]
                        if words and words[-1] not in FRAMES and HAVING.isdisjoint(words):
                            self.boilerplate |= not NAMES.isdisjoint(words)
                            self.comment |= not COMMENT.isdisjoint(words)

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def parse(page: str) -> Node:
    root = Node("body", None)
    #: The open elements, the root first, and at which depths those of each name stand.
    path, depths = [root], {}
    links = 0
    end = 0

    def add(text: str) -> None:
        if text:
            at = path[-1]
            at.parts.append(text)
            n = sum(map(len, text.split()))
            at.chars += n
            if links:
                at.link_chars += n

    def close(depth: int) -> None:
        """Ends the element at this depth and all inside it."""
        while len(path) > depth:
            depths[path.pop().tag].pop()

    def deepest(tags: set[str]) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    while m := TOKEN.search(page, end):
        add(html.unescape(page[end : m.start()]))
        end = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE and tag not in VOID and depths.get(tag):
                close(depths[tag][-1])
                links = 0
            continue
        if tag in RAW:
            close_tag = RAW_END[tag].search(page, end)
            end = close_tag.end() if close_tag else len(page)
            continue
        path[-1].tags += 1
        if tag == "br" or tag == "hr":
            add(" ")
        if tag == "a":
            links += 1
            path[-1].link_tags += 1
        if tag in INLINE or tag in VOID:
            continue
        if tag in ENDS:
            depth = deepest(ENDS[tag])
            if depth > deepest(BOUNDS[tag]):
                close(depth)
        elif path[-1].tag == "p" or path[-1].tag in HEADINGS and tag == path[-1].tag:
            close(len(path) - 1)
        if path[-1].tag == "p":
            close(len(path) - 1)
        links = 0
        node = Node(tag, path[-1], m[3])
        path[-1].parts.append(node)
        depths.setdefault(tag, []).append(len(path))
        path.append(node)
    add(html.unescape(page[end:]))
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes, parents first."""
    found = [root]
    for node in found:
        found += node.children()
    return found


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") and not node.comment or node.role == "main"


#: Which classes and ids count: all; those of elements that hold no other named one; none.
ALL, INNERMOST, NONE = range(3)


def _leaves(node: Node, inside: bool, holds: tuple[bool, bool, bool, int], names: int) -> bool:
    """Whether what an element says of itself makes it no main text. `inside`: it stands in an article; `holds`: whether it has
    parts of a page, headings, names below it, and how many paragraphs; `names`: which classes and ids count."""
    framed, headed, named, paragraphs = holds
    if node.main:
        return False
    if node.tag == "form":
        # The frame of a whole page, as server-side frameworks write it, is no form to fill in.
        return not framed and paragraphs < 3
    if node.tag == "header" and inside and not node.role:
        return not headed
    if node.tag in DROPPED or node.role in ROLES:
        return True
    return (names == ALL or names == INNERMOST and not named) and (node.boilerplate and node.tag not in ("article", "main") or node.comment)


def prune(root: Node) -> None:
    nodes = _walk(root)
    holds: dict[int, tuple[bool, bool, bool, int]] = {}
    for node in reversed(nodes):
        below = node.children()
        framed = node.tag in FRAME or any(holds[id(c)][0] for c in below)
        headed = node.tag in HEADINGS or any(holds[id(c)][1] for c in below)
        named = any(c.boilerplate or c.comment or holds[id(c)][2] for c in below)
        holds[id(node)] = (framed, headed, named, (node.tag == "p" and node.chars > 0) + sum(holds[id(c)][3] for c in below))
        node.main = _is_main(node) or any(c.main for c in node.children())
    inside = {id(root): False}
    for node in nodes:
        for c in node.children():
            inside[id(c)] = inside[id(node)] or _is_main(node)
    whole = {id(node): node.parts for node in nodes}
    # Names take nothing away from a page that has no other text.
    for names in (ALL, INNERMOST, NONE):
        for node in nodes:
            node.parts = [p for p in whole[id(node)] if isinstance(p, str) or not _leaves(p, inside[id(p)], holds[id(p)], names)]
        if any(n.chars for n in _walk(root)):
            break


def weigh(root: Node) -> list[Node]:
    """Counts over subtrees, densities and sums; the nodes, parents first."""
    nodes = _walk(root)
    for node in reversed(nodes):
        for c in node.children():
            node.chars += c.chars
            node.tags += c.tags
            node.link_chars += c.link_chars
            node.link_tags += c.link_tags
    share = root.link_chars / max(root.chars, 1)
    for node in nodes:
        c, t = node.chars, max(node.tags, 1)
        lc, lt, nlc = max(node.link_chars, 1), max(node.link_tags, 1), max(c - node.link_chars, 1)
        if c:
            base = math.log(c * lc / nlc + share * c + math.e)
            node.density = c / t * max(math.log(max(c / lc * t / lt, 1)), 0) / max(math.log(base), 0.1)
    for node in nodes:
        node.sum = sum(c.density for c in node.children())
    return nodes


def _mains(nodes: list[Node]) -> list[Node]:
    """The topmost article and main elements with text; those in asides or comments only where there are no others."""
    found, inside, asides = [], set(), set()
    for node in nodes:
        up = node.parent
        if up is not None and (id(up) in asides or up.tag in DROPPED or up.role in ROLES or up.comment):
            asides.add(id(node))
        if up is not None and id(up) in inside:
            inside.add(id(node))
        elif _is_main(node):
            inside.add(id(node))
            if node.chars:
                found.append(node)
    return [n for n in found if id(n) not in asides] or found


def _prose(nodes: list[Node]) -> set[int]:
    """The nodes whose subtrees have a paragraph (or other element of one block), or several blocks of text."""
    blocks: dict[int, int] = {}
    for node in reversed(nodes):
        own = bool(node.chars) and any(isinstance(p, str) and p.strip() for p in node.parts)
        blocks[id(node)] = 2 if node.chars and node.tag in BLOCKS else own + sum(blocks[id(c)] for c in node.children())
    return {k for k, n in blocks.items() if n > 1}


def _marked(nodes: list[Node]) -> list[Node]:
    """What the densities mark: under each node that reaches the threshold the node of the largest sum."""
    root, best, prose = nodes[0], {}, _prose(nodes)
    for node in reversed(nodes):
        best[id(node)] = max([node, *(best[id(c)] for c in node.children())], key=lambda n: n.sum)
    node = best[id(root)]
    low = high = node.density
    # Single blocks have no tags to divide by, so they are held against the blocks of the best node too.
    parts = [c.density for c in node.children() if c.density > 0]
    while node is not None:
        low, high = min(low, node.density), high if node is root else min(high, node.density)
        node = node.parent
    high = max(high, sum(parts) / max(len(parts), 1))
    # The body itself is taken whole only for text that stands in no other element.
    whole = any(isinstance(p, str) and p.strip() for p in root.parts) or not any(c.density >= low > 0 for c in root.children())
    chosen: dict[int, Node] = {}
    stack = [root]
    while stack:
        node = stack.pop()
        if id(node) in chosen:
            continue
        if node.chars and (node is root or node.density >= (low if id(node) in prose else high) and node.density > 0):
            found = best[id(node)] if best[id(node)].sum else node
            if found is not root or whole:
                chosen[id(found)] = found
                if found is node:
                    continue
        stack += reversed(node.children())
    return list(chosen.values())


def _dense(nodes: list[Node]) -> list[Node]:
    """What the densities mark, and the prose beside it, in page order."""
    root = nodes[0]
    chosen = {id(n): n for n in _marked(nodes)}
    around = set()
    for node in chosen.values():
        while (node := node.parent) is not None and id(node) not in around:
            around.add(id(node))
    # Short prose has low densities; what stands beside marked nodes belongs to them, but for lists of links.
    prose = _prose(nodes)
    for parent in {id(n.parent): n.parent for n in chosen.values() if n.parent is not None}.values():
        for c in parent.children():
            if c.chars and id(c) in prose and id(c) not in around and 2 * c.link_chars < c.chars:
                chosen[id(c)] = c
    return _topmost(root, set(chosen))


def _topmost(root: Node, chosen: set[int]) -> list[Node]:
    """The chosen nodes that no other holds, in page order."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if id(node) in chosen:
            found.append(node)
        else:
            stack += reversed(node.children())
    return found


def select(root: Node) -> list[Node]:
    """The nodes whose subtrees are main text, in page order.

    The densities say where it is. The page's article and main elements are it as a whole where they hold most of what the
    densities found; where they don't, as teasers beside the prose, they stay beside what the densities found.
    """
    nodes = weigh(root)
    dense, mains = _dense(nodes), _mains(nodes)
    if not mains:
        return dense
    tops, own = {id(m) for m in mains}, {id(n) for m in mains for n in _walk(m)}
    held = 0
    for node in dense:
        held += node.chars if id(node) in own else sum(n.chars for n in _walk(node) if id(n) in tops)
    return mains if 2 * held >= sum(n.chars for n in dense) else _topmost(root, tops | {id(n) for n in dense})


def blocks(root: Node) -> list[str]:
    found, held = [], []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            found.append(text)

    stack: list[str | Node | None] = [root]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            held.append(part)
        else:
            flush()
            if part is not None:
                stack += [None, *reversed(part.parts)]
    flush()
    return found


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n\n".join(b for node in select(root) for b in blocks(node))


def extracted(page: Column) -> Column:
    """Column of the main texts of the pages in column `page`."""
    bounded_batches()

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for p in column.to_pylist()], pa.string())

    return text(page)
