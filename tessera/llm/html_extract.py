"""Main text of web pages by composite text density.

The page becomes a tree of nodes. Forms, scripts, navigation and other nodes that name themselves as no
content go first. Each node then has C characters and T tags beneath it, and LC characters and LT tags in
links; its composite density is C/T scaled by a logarithm of (C * T) / (LC * LT), whose base grows with the
share of links in the node and in the body, so many linked characters make it small. A node's density sum adds
its children's densities. The node of maximum density sum marks the content; the smallest density on the path
from the body to it is the threshold. From the body down, every subtree that is that dense gives its part of
maximum sum; an article around the marked node is kept whole, and headings right before a kept part go with it.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.session import ship, spread, tidy

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template iframe object embed canvas svg math form button select textarea input nav header footer aside menu dialog head title".split())
BLOCKS = frozenset("address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header footer hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body caption html legend option optgroup tbody td tfoot th thead tr dd dt li".split()) | {"li", "dd", "dt"}
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NO_CONTENT = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|notices|alert|newsletter|subscribe|signup|login|popup|modal|overlay"
    r"|nav|navbar|navigation|menu|menubar|breadcrumbs?|pagination|pager|sidebar|side|aside|footer|foot|header|masthead|toolbar|share|sharing|social|related|recommended"
    r"|comments?|commentlist|respond|replies|reply|disqus|widget|skip|hidden)",
    re.I,
)
BESIDE = frozenset("site page main global top bottom left right upper lower primary secondary first second third mobile desktop list lists item items link links bar box area section form block container wrapper wrap inner button buttons icon icons post posts article articles story stories content media text slot unit policy message toggle body to reader readers user users visitor visitors guest guests latest recent popular sticky fixed floating inline privacy".split())  # with a listed word they name no content; with, no, has, overflow and so on turn its meaning
HEADS, OF_ARTICLES = frozenset("header masthead".split()), frozenset("article post story content".split())
CONTENT = frozenset("content article post story entry main body text".split())
UNWRAPPED = frozenset("form nav header footer aside menu dialog".split())  # of DROPPED: may hold the article of a badly made page
WEAK = re.compile(r"(?:related|recommended|widget|side|foot|toolbar|skip)", re.I)  # inside an article these drop a node only if it is mostly links
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
# A quote opens a value only right after '='; possessive repeats never give back, so no page takes more than linear time.
_VALUE = r"""=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_TOKEN = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:{_VALUE}|[^>=])*+)(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "out", "weak", "article", "c", "t", "lc", "lt", "density", "total")

    def __init__(self, tag: str, parent: Node | None, out: bool, weak: bool = False):
        self.tag, self.parent, self.out, self.weak = tag, parent, out, weak
        self.article = tag in ("article", "main") or parent is not None and parent.article
        self.children: list[Node | str] = []


def _no_content(value: str, article: bool) -> str:
    """The listed words of the class or id that is, as a whole, a listed word, or listed words with words beside them
    ('site-nav'); none: ''. What heads an article is its title."""
    tokens = _HUMP.sub("-", value).lower().split()
    if article and not CONTENT.isdisjoint(tokens):
        return ""  # one name says content
    for token in tokens:
        words = [w for w in re.split(r"[_-]+", token) if w]
        listed = [w for w in words if NO_CONTENT.fullmatch(w)]
        if listed and all(w in BESIDE or w.isdigit() or NO_CONTENT.fullmatch(w) for w in words) and not (HEADS.issuperset(listed) and (article or not OF_ARTICLES.isdisjoint(words))):
            return " ".join(listed)
    return ""


def _named_away(tag: str, attributes: str, article: bool) -> tuple[bool, bool]:
    """Whether the node is taken for no content, and whether only a weak name inside an article says so."""
    if tag in DROPPED and not (tag == "header" and article):
        return True, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    weak = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and (listed := _no_content(value, article)):
            if not article or not all(map(WEAK.fullmatch, listed.split())):
                return True, False
            weak = True
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
    return weak, weak


def unwrap(body: Node) -> None:
    """Weakly named nodes whose text is mostly unlinked are kept. Dropped nodes that hold an article are taken for wrappers and kept, the largest first, unless an article with a
    tenth of the page's unlinked text stands outside all dropped nodes; so are forms and nodes dropped for their name
    that hold most of that text, if no article stands outside."""
    text: dict[Node, int] = {}
    all_text: dict[Node, int] = {}
    holds: set[Node] = set()
    order, todo = [], [body]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and not _gone(c)]
    for node in reversed(order):
        own = sum(len(_SPACE.sub("", c)) for c in node.children if isinstance(c, str))
        text[node] = 0 if node.tag == "a" else own + sum(text[c] for c in node.children if isinstance(c, Node) and not _gone(c))
        all_text[node] = own + sum(all_text[c] for c in node.children if isinstance(c, Node) and not _gone(c))
        if node.weak and 2 * text[node] > all_text[node]:
            node.out = False
        if node.tag == "article" or any(c in holds for c in node.children if isinstance(c, Node)):
            holds.add(node)
    whole, kept, found, todo = text[body], 0, [], [body]
    while True:
        while todo:
            node = todo.pop()
            for child in node.children:
                if isinstance(child, str):
                    kept += len(_SPACE.sub("", child)) if node.article and text[node] else 0
                elif not _gone(child):
                    if child.out:
                        heapq.heappush(found, (-text[child], len(found), id(child), child))
                    else:
                        todo.append(child)
        if not whole or kept * 10 >= whole:
            return
        while found:
            size, _, _, node = heapq.heappop(found)
            if node in holds and size or -size * 2 > whole and not kept and (node.tag == "form" or node.tag not in DROPPED):
                node.out = False
                todo.append(node)
                break
        else:
            return


def _gone(node: Node) -> bool:
    return node.out and node.tag in DROPPED and node.tag not in UNWRAPPED


SCOPES = ("td", "th", "table", "button", "object", "article", "section", "div")
BARRIERS = ("article", "main", "section", "td")


class Open:
    """The open nodes, and for each tag where it stands among them, so what closes what is known without a walk."""

    def __init__(self, body: Node):
        self.nodes, self.places = [body], {}

    @property
    def now(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Closes the node at `place` and all within it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def last(self, *tags: str) -> int:
        """Where the innermost open node of these tags stands; 0, the body's place, if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def paragraph(self) -> int:
        """Where the open paragraph stands that a block would close; 0 if there is none."""
        p = self.last("p")
        return p if p > self.last(*SCOPES) else 0


def parse(page: str) -> Node:
    """A tree that follows the rules of HTML for what closes what, as far as text needs them; in linear time."""
    root = Node("html", None, False)
    body = Node("body", root, False)
    root.children.append(body)
    open_, at = Open(body), 0
    match = _TOKEN.search(page)
    while match:
        if match.start() > at:
            open_.now.children.append(page[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag:
            tag = tag.lower()
            if match[1]:
                if tag == "p" and not open_.paragraph():
                    open_.now.children.append(Node("p", open_.now, False))
                elif tag == "br":
                    open_.now.children.append(Node("br", open_.now, False))
                elif tag not in ("html", "body") and (place := open_.last(tag)) and (tag in BLOCKS or place >= open_.last(*BARRIERS)):
                    open_.cut(place)
            elif tag not in ("html", "body"):
                if tag in CLOSES_P and (place := open_.paragraph()):
                    open_.cut(place)
                if tag in CLOSED_BY:
                    closed, stop = CLOSED_BY[tag]
                    if (place := open_.last(*closed)) > open_.last(*stop):
                        open_.cut(place)
                        if tag == "tr" and open_.now.tag in closed:
                            open_.cut(len(open_.nodes) - 1)
                node = Node(tag, open_.now, *_named_away(tag, match[3], open_.now.article))
                open_.now.children.append(node)
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                    node.children.append(page[at : end.start() if end else len(page)])
                    at = end.end() if end else len(page)
                elif tag not in VOID and not match[3].rstrip().endswith("/") or tag not in VOID and tag in BLOCKS:
                    open_.push(node)
        match = _TOKEN.search(page, at)
    if at < len(page):
        open_.now.children.append(page[at:])
    return body


def measure(body: Node) -> None:
    """Characters, tags, linked characters and tags, densities and density sums, children before parents."""
    order, todo = [], [body]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and not c.out]
    for node in reversed(order):
        node.c = node.t = node.lc = node.lt = 0
        for child in node.children:
            if isinstance(child, str):
                node.c += len(_SPACE.sub("", html.unescape(child) if "&" in child else child))
            elif not child.out:
                node.c += child.c
                node.t += child.t + 1
                node.lc += child.c if child.tag == "a" else child.lc
                node.lt += child.t + 1 if child.tag == "a" else child.lt
        if node.tag == "a":
            node.lc, node.lt = node.c, node.t
    for node in reversed(order):
        node.density = density(node, body)
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.out)
        if any(isinstance(c, str) and not c.isspace() for c in node.children):
            node.total += node.density  # text of its own counts as a child


def density(node: Node, body: Node) -> float:
    """C/T * log_b((C * T) / (LC * LT)), b = ln(C * LC / other + LC_body * C / C_body + e); 0 counts are 1."""
    if not node.c:
        return 0.0
    tags, linked, link_tags = max(node.t, 1), max(node.lc, 1), max(node.lt, 1)
    base = math.log(node.c / max(node.c - node.lc, 1) * node.lc + body.lc / max(body.c, 1) * node.c + math.e)
    scale = math.log(max(node.c / linked * tags / link_tags, 1e-9)) / math.log(max(base, 1.0 + 1e-9)) if base > 1.0 + 1e-9 else math.log(max(node.c / linked * tags / link_tags, 1e-9))
    return node.c / tags * max(scale, 0.0)


def content(body: Node) -> list[Node]:
    """The kept subtrees, in page order. The node of maximum density sum gives the threshold, the least density on its
    path from the body; from the body down, through nodes that reach it, each node's subtree of maximum sum is kept.
    Of equal sums the outer node counts, then the first in page order, but the body last. Parts beside a kept part in
    one holder below the body go with it if their text is mostly unlinked, however short, and so do headings before it."""
    order, todo = [], [body]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += reversed([c for c in node.children if isinstance(c, Node) and not c.out])
    top: dict[Node, Node] = {}
    for node in reversed(order):
        tops = [top[c] for c in node.children if isinstance(c, Node) and not c.out]
        top[node] = max([*tops, node] if node is body else [node, *tops], key=lambda x: x.total)
    best = top[body]
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    least = min(path, key=lambda x: x.density)
    threshold, a_tag = least.density * (1 - 1e-9), least.c / max(least.t, 1)
    whole = best
    while whole is not body and whole.tag in INNER:  # blocks and inline marks are parts of a content node, not one
        whole = whole.parent
    kept, todo = {_article(path) or whole}, [body]
    while todo:
        node = todo.pop()
        short = (node.c - node.lc) / max(node.t, 1) < a_tag  # the logarithm grows with size, so a small part has its unlinked text a tag as well
        if node.density < threshold and short or node in kept:
            continue
        if top[node] is not best and top[node].c:
            kept.add(top[node])
        todo += [c for c in node.children if isinstance(c, Node) and not c.out]
    holders = {node.parent: None for node in kept if node.parent is not None}
    for holder in holders:
        if holder is not body and holder.parent is not None:
            kept |= {c for c in holder.children if isinstance(c, Node) and not c.out and 2 * (c.c - c.lc) > c.c}
    for holder in holders:
        kept |= _headings(holder, kept)
    out, todo = [], [body]
    while todo:
        node = todo.pop()
        if node in kept:
            out.append(node)
        else:
            todo += reversed([c for c in node.children if isinstance(c, Node) and not c.out])
    return out


def _article(path: list[Node]) -> Node | None:
    """The nearest article around the content: its title and short parts are under any threshold, and belong to it."""
    return next((node for node in path if node.tag == "article"), None)


def _headings(holder: Node, kept: set[Node]) -> set[Node]:
    """The holder's headings, or nodes of nothing but headings, that stand right before a kept node."""
    out, found = set(), []
    for child in holder.children:
        if isinstance(child, str):
            found = found if child.isspace() else []
        elif child in kept:
            out.update(found)
            found = []
        elif not child.out and child.c:
            if _titles(child):
                found.append(child)
            else:
                found = []
    return out


def _titles(node: Node) -> bool:
    """Whether all text of a node stands in headings."""
    todo = [node]
    while todo:
        node = todo.pop()
        if node.tag in HEADINGS or isinstance(node, Node) and node.out:
            continue
        for child in node.children:
            if isinstance(child, Node):
                todo.append(child)
            elif not child.isspace():
                return False
    return True


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INNER = frozenset("a abbr b big blockquote br cite code dd dfn dl dt em font h1 h2 h3 h4 h5 h6 i kbd li mark ol p pre q s samp small span strike strong sub sup td th tr tbody thead tfoot table tt u ul var".split())


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the nodes' blocks in page order, white space made one space; a line break ends a block
    only where it stands next to another block."""
    out, run = [], []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [x for node in reversed(nodes) for x in (None, node)]
    while todo:
        item = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            run.append(html.unescape(item) if "&" in item else item)  # by itself: a reference does not reach over a tag
        elif not item.out:
            if item.tag == "br":
                run.append(" ")
            elif item.tag in BLOCKS:
                close()
                todo.append(None)
            todo += reversed(item.children)
    close()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    body = parse(page)
    unwrap(body)
    measure(body)
    return "\n\n".join(blocks(content(body)))


def extract(pages: DataFrame, html_: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, text (main text of the whole page, blocks parted by an empty line) and n_chars (its
    code points).

    A null or empty page, and one without content, has an empty text and 0 characters. Broken markup is read as
    browsers do: unclosed nodes end with what holds them or at the end of the page. Rows come through one to
    one; columns outside `keep` are dropped. One map over the scan."""
    ship(pages.sparkSession)
    part = spread(pages.select(*keep, F.col(html_).cast("string").alias("__html")))
    names = [*keep, "text", "n_chars"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1]), "text string, n_chars long"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                texts = [main_text(p) for p in piece.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    return part.mapInArrow(tidy(run), schema)
