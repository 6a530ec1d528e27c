"""Main text of web pages by composite text density.

Every node gets a density: its characters per tag, adjusted by how much of the text is links, times a weight. The weight
tells what its name, role and class say of it: 0 for what is never an article (menus, page headers and footers, sidebars,
notices, adverts, forms, reader comments), WEAK where a class only hints at that, else 1; it holds for all below. A name
has no say over a node that holds what the page has to read: a wrapper around paragraphs beside which there is next to
nothing gets weight 1. A node's sum adds the densities of its children, and the article is around the node with the
greatest sum. The least density on the path from there to the body is the threshold: what is beside the path counts as
text if it or its children together are as dense, if it holds a main heading, or if it is a paragraph, heading or the
like. Where a `main`, or else the page's only `article`, holds most of the text, the article is in it, and what lies
outside of it is no text but for a main heading.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Fixed sets of HTML: elements without content, ones that begin a line of their own, ones whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript textarea iframe title xmp noembed noframes".split())
#: What limits the search for an open p that a block ends.
P_SCOPE = ("button", "table", "td", "th", "div", "article", "section", "li", "blockquote", "main")
#: A start tag in the key closes an open element of the value, up to the nearest of the second value.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Never shown as text.
SKIPPED = frozenset("head script style noscript template iframe object svg canvas audio video map button select textarea input label".split())
#: Weight 0 by name or role.
APART = frozenset("nav footer aside form dialog menu search".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id: a name of such words alone has weight 0; among other words they are a hint.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored promo promos promotion banner banners sidebar sidebars rail nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer masthead topbar toolbar "
    "comment comments comentarios kommentare commentaires disqus respond reply replies cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social pagination pager paywall".split()
)
#: Words that are a hint in any case, and words that say nothing beside others.
HINTS = frozenset("side aside head header related recommended recommendations discussion widget widgets skip form search toc copyright disclaimer tags".split())
NEUTRAL = frozenset("area bar block body bottom box btn button buttons card cards col column container content count desktop fixed group header icon icons id inner item items js left link links list message mobile module outer page panel post posts right row section site slot sticky text thread title top unit user wrap wrapper zone".split())
WEAK = 0.25
ROOTS = frozenset(["html", "body", "main", "article"])
#: Share of link text from which a list or row counts as a menu.
LINK_PART = 0.6
MENUS = frozenset("ul ol dl menu dir table div section".split())
#: Blocks of running text, which count beside the densest node however short they are.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre figure figcaption details summary li dt dd".split())
#: Words of a class that name reader comments, whose weight stays 0 however much they hold; elements whose weight a name gives.
READERS = frozenset("comment comments comentarios kommentare commentaires disqus respond reply replies discussion".split())
NAMED = frozenset("div section article main span center td aside dialog".split())
#: What a wrapper holds for its name to have no say: so many paragraphs of so many characters, and so many times the text outside.
PARAGRAPHS, LONG, TIMES = 3, 80, 4

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def scan(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Pieces of a page in order: ("", text, {}), ("<", tag, attributes), ("/", tag, {}). Each character is looked at a few times at most.

    A quote without its pair ends at the tag's first >; so does one whose pair is followed by what can't follow a value.
    A tag that never ends is left out with all behind it.
    """
    at = text = 0
    n = len(page)
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        c = page[at + 1 : at + 2]
        end = -1
        if c in ("!", "?") and c:
            end = page.find("-->", at + 4) if page.startswith("<!--", at) else page.find(">", at)
            end = end + (3 if page.startswith("<!--", at) else 1) if end >= 0 else n
            found = None
        elif c == "/" and page[at + 2 : at + 3].isalpha():
            name = _NAME.match(page, at + 2)
            end = page.find(">", at) + 1 or n
            found = ("/", name[0].lower(), {}) if name else None
        elif c.isascii() and c.isalpha():
            name = _NAME.match(page, at + 1)
            attributes, end = _attributes(page, name.end())
            found = ("<", name[0].lower(), attributes) if end else None
            end = end or n
        else:
            at += 1
            continue
        if at > text:
            yield "", page[text:at], {}
        at = text = end
        if found:
            yield found
            if found[0] == "<" and found[1] in RAW:
                close = _RAW_ENDS[found[1]].search(page, end)
                at = text = close.start() if close else n
    if text < n:
        yield "", page[text:], {}


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from `at` on and the place behind the tag; 0 if it never ends."""
    out: dict[str, str] = {}
    while True:
        at = _GAP.match(page, at).end()
        if page[at : at + 1] == ">":
            if page[at - 1] == "/":
                out["/"] = ""
            return out, at + 1
        if at >= len(page):
            return out, 0
        name = _ATTRIBUTE.match(page, at)
        at, value = name.end(), ""
        equals = _EQUALS.match(page, at)
        if equals:
            at = equals.end()
            quote = page[at : at + 1]
            close = page.find(quote, at + 1) if quote in ("'", '"') and quote else -1
            if close >= 0 and (page[close + 1 : close + 2].isspace() or page[close + 1 : close + 2] in ("", "/", ">")):
                value, at = page[at + 1 : close], close + 1
            elif quote in ("'", '"') and quote:
                end = page.find(">", at)
                if end < 0:
                    return out, 0
                value, at = page[at + 1 : end], end
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        out.setdefault(name[0].lower(), value)


def weight(tag: str, attributes: dict[str, str], in_article: bool) -> float | None:
    """What an element's name, role, class and id say of it: 0, WEAK or 1; None: it is never shown."""
    if tag in SKIPPED or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", "")):
        return None
    if tag in APART or tag == "header" and not in_article or attributes.get("role", "").lower() in APART_ROLES:
        return 0.0
    out = 1.0
    if tag not in ROOTS or tag == "article":
        for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
            words = [w.lower() for w in _WORDS.findall(name)]
            strong = sum(w in STRONG for w in words)
            if strong and all(w in STRONG or w in HINTS or w in NEUTRAL or w.isdigit() for w in words):
                return 0.0
            if strong or any(w in HINTS for w in words):
                out = WEAK
    return out


class Node:
    __slots__ = ("tag", "parent", "parts", "own", "weight", "article", "readers", "out", "chars", "tags", "link_chars", "link_tags", "shown", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, own: float, article: bool, readers: bool = False):
        self.tag, self.parent, self.own, self.article, self.readers, self.out = tag, parent, own, article, readers, False
        self.weight = own * (parent.weight if parent else 1.0)
        self.parts: list[str | Node] = []


class Stack:
    """Open elements, with the places of each name, so that no search walks through them."""

    def __init__(self, root: Node):
        self.nodes, self.where = [root], {}

    def push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these names; 0: none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def cut(self, at: int) -> None:
        for node in self.nodes[at:]:
            self.where[node.tag].pop()
        del self.nodes[at:]


def parse(page: str) -> Node:
    """The page's tree without what is never shown; unclosed and unopened tags are mended as browsers mostly do."""
    root = Node("html", None, 1.0, False)
    open_ = Stack(root)
    hidden = 0  # place of the outermost open element that is not shown
    for kind, x, attributes in scan(page):
        top = open_.nodes[-1]
        if not kind:
            if not hidden:
                top.parts.append(x)
            continue
        if kind == "/":
            at = open_.last(x)
            if at:
                open_.cut(at)
                if hidden >= len(open_.nodes):
                    hidden = 0
            elif x == "p" and not hidden:
                top.parts.append(Node("p", top, 1.0, top.article))
            continue
        if x == "html" or x in ("body", "form") and open_.last(x):
            continue
        if x in BLOCK:
            if x == "body":
                open_.cut(1)
            p = open_.last("p")
            if p and p > open_.last(*P_SCOPE):
                open_.cut(p)
            if x in CLOSES:
                ended, scope = CLOSES[x]
                inner, limit = open_.last(*ended), open_.last(*scope)
                if inner > limit:
                    # all of these names above the limit end: the outermost of them is closed
                    open_.cut(min(k for t in ended for k in open_.where.get(t, ())[-1:] if k > limit))
            if hidden >= len(open_.nodes):
                hidden = 0
        top = open_.nodes[-1]
        own = None if hidden else weight(x, attributes, top.article)
        readers = own == 0 and any(w.lower() in READERS for w in _WORDS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}"))
        node = Node(x, top, own or 0.0, top.article or x in ("article", "main"), readers)
        if own is not None:
            top.parts.append(node)
        if x not in VOID and "/" not in attributes:
            if own is None and not hidden:
                hidden = len(open_.nodes)
            open_.push(node)
    return root


def _order(root: Node) -> list[Node]:
    """All nodes below root that are not left out, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [p for p in n.parts if not isinstance(p, str) and not p.out]
    return out


def _show(nodes: list[Node]) -> None:
    """The characters below each node that are no link and have a weight. nodes: parents first."""
    for n in reversed(nodes):
        own = sum(len(p) - p.count(" ") - p.count("\n") for p in n.parts if isinstance(p, str))
        n.shown = own + sum(p.shown for p in n.parts if not isinstance(p, str)) if n.weight and n.tag != "a" else 0


def measure(root: Node) -> list[Node]:
    """Counts, density and sum of every node."""
    nodes = _order(root)
    for n in reversed(nodes):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for p in n.parts:
            if isinstance(p, str):
                n.chars += len(p) - p.count(" ") - p.count("\n")
            else:
                n.chars += p.chars
                n.tags += p.tags + 1
                n.link_chars += p.link_chars
                n.link_tags += p.link_tags + (p.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    body = next((n for n in nodes if n.tag == "body"), root)
    _show(nodes)
    wrapper = next((n for n in nodes if _wraps(n, body)), None)
    if wrapper is not None:
        wrapper.own = 1.0
        for n in _order(wrapper):
            n.weight = n.own * (n.parent.weight if n.parent else 1.0)
        _show(nodes)
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in nodes:
        n.density = 0.0
        if n.chars and n.weight:
            tags, links, link_tags = max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
            base = math.log(n.chars / max(n.chars - n.link_chars, 1) * n.link_chars + share * n.chars + math.e)
            n.density = n.weight * n.chars / tags * math.log(max(n.chars / links * tags / link_tags, 1.0) + 1e-9) / math.log(max(base, 1.0) + 1e-3)
    for n in nodes:
        n.sum = sum(p.density for p in n.parts if not isinstance(p, str))
        n.out = not n.weight
    return nodes


def _wraps(n: Node, body: Node) -> bool:
    """Whether a node of weight 0 is around what the page has to read: a form with most of the characters, or a named wrapper of paragraphs beside which little is."""
    if n.weight or n.parent is not None and not n.parent.weight:
        return False
    below = _order(n)
    if n.tag == "form":
        return 2 * n.chars > body.chars and any(p.tag in ("p", "article", "main") for p in below)
    if n.tag not in NAMED or n.readers or n.chars - n.link_chars <= TIMES * body.shown:
        return False
    long = sum(p.tag == "p" and p.chars - p.link_chars >= LONG for p in below)
    return long >= PARAGRAPHS or any(p.tag in ("h1", "article", "main") and p.chars for p in below) and long > 0


def _bounds(nodes: list[Node]) -> Node | None:
    """The first main, or else the page's only article, if it holds most of the text that is no link and has a weight."""
    mains, articles = ([n for n in nodes if n.tag == tag] for tag in ("main", "article"))
    found = next(iter(mains), articles[0] if len(articles) == 1 else None)
    return found if found is not None and 2 * found.shown > nodes[0].shown else None


def _menu(n: Node) -> bool:
    return n.tag in MENUS and n.link_tags > 1 and n.link_chars > LINK_PART * n.chars


def _heads(n: Node) -> bool:
    return any(x.tag == "h1" and x.chars for x in _order(n))


def article(root: Node) -> tuple[Node, set[int]] | None:
    """The node around the main text, and the nodes (by identity) whose lists of links are text; what is beside the article and no text is marked as left out."""
    nodes = [n for n in measure(root) if n.chars and n.weight]
    if not nodes:
        return None
    best, bounds = max(nodes, key=lambda n: (n.sum, n.density, n.chars)), _bounds(nodes)
    around = bounds
    while around is not None and around is not best:
        around = around.parent
    best = bounds if around is not None else best  # the densest node is around the bounds: few of its children are the article
    path = [best]
    while path[-1].parent is not None and path[-1].tag != "body":
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    for n in path[1:]:
        n.out = False
    outside = False
    for inner, n in zip(path, path[1:]):
        outside = outside or inner is bounds
        if outside:
            n.parts = [p for p in n.parts if p is inner or not isinstance(p, str) and _heads(p)]
        loose = [p for p in n.parts if isinstance(p, str) or p is not inner and not p.out and p.tag not in BLOCK]
        links = [p.link_chars for p in loose if not isinstance(p, str)]
        if sum(links) > LINK_PART * sum(len("".join(p.split())) if isinstance(p, str) else p.chars for p in loose):
            gone = {id(p) for p in loose}
            n.parts = [p for p in n.parts if id(p) not in gone]  # a bare row of links
        for p in n.parts:
            # what is beside the path is text if it is dense itself or holds dense parts; lines of text and headings need not be
            if not isinstance(p, str) and p is not inner and not p.out and p.chars:
                text = p.tag not in BLOCK or p.tag in TEXT and p.weight == n.weight
                p.out = not text and max(p.density, p.sum) < threshold and not _heads(p)
    return path[-1], {id(n) for n in _order(best)} if best.tag not in ("body", "html") else set()


def blocks(root: Node, kept: set[int] = frozenset()) -> list[str]:
    """Texts of the blocks below root in page order, white space made one space.

    Lists and rows of links are menus and left out, but not in an article or main, nor in the nodes of `kept`; there only those of which a class hints at it.
    """
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif not x.out:
            inside = x.article or id(x) in kept
            if x is not root and _menu(x) and (not inside or x.parent is not None and x.weight < x.parent.weight):
                continue
            if x.tag in BLOCK:
                end()
                todo.append(None)
            todo += reversed(x.parts)
    end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page as lines, one for each block; empty if there is none."""
    if not page:
        return ""
    found = article(parse(page))
    return "\n".join(blocks(*found)) if found else ""


def extract(pages: DataFrame) -> DataFrame:
    """Each row of pages (page_id, url, html) as page_id, url, text and n_chars (code points of text).

    Null, empty and tagless pages are taken as they are: no html gives an empty text, mere text is one block. Pages of
    any length are parsed whole. Equal rows give equal texts; other columns are ignored; no rows give no rows.
    """

    def run(batches):
        for batch in common.slices(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return common.tune(pages).select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
