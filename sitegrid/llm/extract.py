"""HTML extraction by a tree-structured graphical model.

Every element of a page is a node with a hidden label, content or not. The model is a directed tree: the root's label,
each child's label given its parent's (a table for each kind of child), and each node's features given its label (what
its tag is, what its class, id and role say, how much text it has and how much of that is links). All tables are counted
from labelled pages (llm/html_pages.py, or pages given). Sum-product messages go up the tree and down again; they give
the exact marginal of each node. A piece of text belongs to the main text if its element's marginal is at least a half.

Pages are read as HTML has it: quotes count only after an equals sign, names are compared part by part, time is linear in
length and depth. Scripts, styles, comments, form controls and the head never hold text. Character references are decoded, white
space in a block becomes one space, blocks are joined by an empty line in page order. Nothing is dropped by length.

Cases: null and empty html, and pages without content, give empty text; unclosed and stray tags are repaired by the usual
rules (a new block ends an open paragraph); a page cut anywhere is read as far as it goes; text outside of any element
counts as the body's, so that a page of plain text is its own main text; repeated rows get equal results; an empty table gives
no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.llm.common import table
from sitegrid.llm.html_pages import HELD_OUT, LABELLED  # noqa: F401

_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]+(?:>|\Z)", re.S)
MARKS = ("!", "?", "/")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_GAP = re.compile(r"[\s/]*")
#: A quote opens a value after an equals sign only; one that isn't closed takes the rest of the page, as in browsers.
_ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
_SPACE = re.compile(r"\s+")
#: Fixed by HTML: elements whose text is never shown as text, without end tags, and those that break a line of text.
RAW = frozenset("script style noscript template textarea title iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("head select option button input datalist".split())
#: An open element of the first kind ends where one of the second begins.
CELLS = frozenset(("td", "th", "li", "button"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KINDS = {"article": "main", "main": "main", "nav": "nav", "menu": "nav", "footer": "foot", "header": "head", "aside": "side", "form": "form", "button": "form", "select": "form", "fieldset": "form", "dialog": "side", "body": "body", "html": "body", "head": "body", "p": "p", "blockquote": "p", "pre": "p", "h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "div": "div", "section": "div", "a": "a"}
#: What names say: whole parts of class, id and role, or two parts next to each other; a plural counts as its singular.
NAMES = {
    "bad": set("nav menu topnav breadcrumb footer sidebar complementary banner promo promotion cookie consent popup modal newsletter comment disqus pagination login signup sponsor sponsored advert advertisement ad adbox adsense toc contentinfo navigation outbrain taboola navbar masthead commentlist commentsection adbanner pagefooter siteheader siteheading cookiebar".split()),
    "weak": set("notice alert subscribe share sharing social related recommend recommended reply widget toolbar copyright side tag".split()),
    "good": set("content article post entry story body text main".split()),
}
#: A word of a name or a heading says more than how often the few labelled pages have it.
WORDS_COUNT = 30
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "legend", "summary"))


class Node:
    """names: class, id and role; y: a label, in labelled pages; own: words right in it; link, hidden: it lies in such an element;
    head: words of its first heading; place: whether it stands before or after an article or main element; like: named as a sibling is."""

    __slots__ = ("head", "hidden", "kids", "label", "like", "link", "links", "names", "own", "parent", "place", "tag", "text", "y")

    def __init__(self, tag: str, names: str, y: str | None, parent: Node | None):
        self.tag, self.names, self.y, self.parent, self.kids, self.text, self.links, self.own, self.label = tag, names, y, parent, [], 0, 0, 0, None
        self.link = tag == "a" or bool(parent and parent.link)
        self.hidden = tag in HIDDEN or bool(parent and parent.hidden)
        self.head, self.place, self.like = (), "", False


def attributes(page: str, at: int) -> tuple[int, dict[str, str]] | None:
    """From the end of a tag's name: where the tag ends, and its attributes; None if the page ends before."""
    got: dict[str, str] = {}
    while True:
        at = _GAP.match(page, at).end()
        if at >= len(page):
            return None
        if page[at] == ">":
            return at + 1, got
        m = _ATTR.match(page, at)
        got.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()


class Open:
    """The open elements, and where among them each tag, blocks and cells stand, so that no step walks down a deep page."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], defaultdict(list)

    def kinds(self, tag: str) -> list[str]:
        return [tag, *["#block"] * (tag in BLOCK), *["#cell"] * (tag in CELLS)]

    def push(self, node: Node) -> None:
        for k in self.kinds(node.tag):
            self.at[k].append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            for k in self.kinds(self.stack.pop().tag):
                self.at[k].pop()

    def last(self, kind: str) -> int:
        return self.at[kind][-1] if self.at[kind] else 0


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str | None]]]:
    """Nodes, parents first, and the pieces of text in page order with their elements; None: a line ends here."""
    root = Node("html", "", None, None)
    nodes, opened, pieces = [root], Open(root), []
    stack, at, end, text_from = opened.stack, 0, len(page), 0

    def text(to: int) -> None:
        if to > text_from and not stack[-1].hidden:
            pieces.append((stack[-1], html.unescape(page[text_from:to])))

    while (at := page.find("<", at)) >= 0:
        if page[at + 1 : at + 2] in MARKS and (m := _COMMENT.match(page, at)):
            text(at)
            at = text_from = m.end()
            continue
        m = _NAME.match(page, at)
        if not m:  # a mere sign
            at += 1
            continue
        text(at)
        found = attributes(page, m.end())
        if found is None:  # a tag cut off at the end
            at = text_from = end
            break
        at, attr = found
        text_from, tag = at, m[2].lower()
        if m[1]:
            if tag in BLOCK:
                pieces.append((stack[-1], None))
            depth = opened.last(tag)
            if depth and (tag in BLOCK or opened.last("#block") < depth):
                opened.cut(depth)
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = text_from = close.end() if close else end
            continue
        if tag == "br":
            pieces.append((stack[-1], " "))
        if tag in VOID:
            if tag == "hr":
                pieces.append((stack[-1], None))
            continue
        if tag in ("html", "body") and opened.last(tag):
            continue
        if tag in BLOCK:
            pieces.append((stack[-1], None))
            k = opened.last("p")
            if k and opened.last("#cell") < k:
                opened.cut(k)
        if tag in CLOSES and stack[-1].tag in CLOSES[tag]:
            opened.cut(len(stack) - 1)
        if tag == "body" and stack[-1].tag == "head":
            opened.cut(len(stack) - 1)
        node = Node(tag, " ".join(attr[k] for k in ("class", "id", "role") if k in attr), attr.get("y"), stack[-1])
        node.hidden |= "hidden" in attr or bool(_UNSEEN.search(attr.get("style", "")))
        stack[-1].kids.append(node)
        nodes.append(node)
        opened.push(node)
    else:
        text(end)
    for node, piece in pieces:
        if piece and (n := len(piece.split())):
            node.text += n
            node.links += n * node.link
            node.own += n
    around(nodes, pieces)
    for node in reversed(nodes):
        if node.parent:
            node.parent.text += node.text
            node.parent.links += node.links
            node.parent.own += node.own * (node.tag not in BLOCK)
    return nodes, pieces


def around(nodes: list[Node], pieces: list[tuple[Node, str | None]]) -> None:
    """What stands at the head of each block and beside it."""
    words: dict[int, list[str]] = defaultdict(list)
    for node, piece in pieces:
        if piece:
            while node.tag not in BLOCK and node.parent:
                node = node.parent
            if node.tag in HEADINGS and len(words[id(node)]) < 8:
                words[id(node)] += _WORD.findall(piece.lower())
    for n in nodes:
        main = next((i for i, k in enumerate(n.kids) if KINDS.get(k.tag) == "main"), None)
        named = Counter((k.tag, k.names) for k in n.kids if k.names)
        for i, k in enumerate(n.kids):
            k.place = "" if main is None or i == main else "before" if i < main else "after"
            k.like = named[k.tag, k.names] > 1
        first = next((k for k in n.kids if k.tag in BLOCK), None)
        if first is not None and first.tag in HEADINGS and first.tag != "h1":
            n.head = tuple(sorted(set(words[id(first)][:8])))


@lru_cache(100_000)
def parts(names: str) -> tuple[str, ...]:
    """Parts of class, id and role; a plural counts as its singular."""
    return tuple(x.removesuffix("s") if len(x) > 3 else {"ads": "ad"}.get(x, x) for x in _PART.findall(re.sub("([a-z])([A-Z])", r"\1 \2", names).lower()))


@lru_cache(100_000)
def said(names: str) -> str:
    """What an element's names say."""
    own = list(parts(names))
    own += [a + b for a, b in zip(own, own[1:])]
    return next((k for k, v in NAMES.items() if not v.isdisjoint(own)), "none")


def kind(node: Node) -> str:
    k = KINDS.get(node.tag, "other")
    return f"{k} with text" if k == "body" and node.own >= 12 else k


def features(node: Node) -> tuple:
    """An element inside a line says little by itself: its label is nearly its parent's."""
    if node.tag not in BLOCK and node.parent:
        return (("inline names", said(node.names)),)
    k, n, names = kind(node), node.text, said(node.names)
    out = ("kind", k), ("names", names), ("size", min(6, n.bit_length() // 2)), ("links", 0 if not n else min(3, 4 * node.links // n)), ("place", node.place), ("like", node.like)
    out += tuple(("part", x) for x in sorted(set(parts(node.names)))) if names == "none" else ()
    out += tuple(("head", x) for x in node.head)
    return (*out, ("weak", n >= 12 and 4 * node.links < n)) if names == "weak" else out


def edges(node: Node) -> tuple[tuple, ...]:
    """Kinds of edge from the parent to this node, from general to special."""
    if node.tag not in BLOCK:
        return ("edge",), ("edge", "inline"), ("edge", "inline", said(node.names))
    own = (kind(node), said(node.names))
    return ("edge",), ("edge", *own), ("edge", *own, kind(node.parent), said(node.parent.names))


def labelled(nodes: list[Node]) -> None:
    for n in nodes:
        n.label = int(n.y) if n.y in ("0", "1") else n.parent.label if n.parent else 0


class Model:
    """Log tables, counted with additive smoothing from labelled pages."""

    def __init__(self, pages: list[str], smooth: float = 0.3, copies: float = 3.0):
        count: dict = defaultdict(lambda: [smooth, smooth])
        total = [0.0, 0.0]
        trans: dict = defaultdict(lambda: [[0.0, 0.0], [0.0, 0.0]])
        values = defaultdict(set)
        self.root = [1.0, 1.0]
        for page in pages:
            nodes, _ = parse(page)
            labelled(nodes)
            for n in nodes:
                total[n.label] += copies
                for f in features(n):
                    count[f][n.label] += copies * (WORDS_COUNT if f[0] in ("part", "head") else 1)
                    values[f[0]].add(f[1])
                if n.parent:
                    for e in edges(n):
                        trans[e][n.parent.label][n.label] += copies
                else:
                    self.root[n.label] += copies
        self.features = {f: [math.log(c[y] / (total[y] + smooth * (len(values[f[0]]) + 1))) for y in (0, 1)] for f, c in count.items()}
        self.edges: dict = {(): [[0.5, 0.5], [0.5, 0.5]]}
        for e in sorted(trans, key=len):  # each kind leans on the more general one before it
            t, wide = trans[e], self.edges[() if len(e) == 1 else ("edge",) if len(e) < 4 else e[:3]]
            self.edges[e] = [[(t[a][b] + 2 * smooth * wide[a][b]) / (sum(t[a]) + 2 * smooth) for b in (0, 1)] for a in (0, 1)]
        s = sum(self.root)
        self.root = [x / s for x in self.root]

    def marginals(self, nodes: list[Node]) -> dict[int, float]:
        """Probability of content for each node: messages to the parents, then back to the children."""
        own, up = {}, {}
        for n in nodes:
            a = b = 0.0
            for f in features(n):
                x = self.features.get(f)
                if x:
                    a, b = a + x[0], b + x[1]
            d = max(-30.0, min(30.0, b - a))
            own[id(n)] = [1 / (1 + math.exp(d)), 1 / (1 + math.exp(-d))]
        tables = {id(n): next(self.edges[e] for e in (*edges(n)[::-1], ()) if e in self.edges) for n in nodes[1:]}
        for n in reversed(nodes):  # children come after their parents
            p = own[id(n)]
            if n.parent:
                t = tables[id(n)]
                m = [t[0][0] * p[0] + t[0][1] * p[1], t[1][0] * p[0] + t[1][1] * p[1]]
                up[id(n)] = m
                q = own[id(n.parent)]
                s = q[0] * m[0] + q[1] * m[1]
                own[id(n.parent)] = [q[0] * m[0] / s, q[1] * m[1] / s]
        out, down = {}, {id(nodes[0]): self.root}
        for n in nodes:
            p, d = own[id(n)], down[id(n)]
            s = p[0] * d[0] + p[1] * d[1]
            b = [p[0] * d[0] / s, p[1] * d[1] / s]
            out[id(n)] = b[1]
            for k in n.kids:
                m, t = up[id(k)], tables[id(k)]
                c = [b[0] / max(m[0], 1e-300), b[1] / max(m[1], 1e-300)]
                x = [c[0] * t[0][0] + c[1] * t[1][0], c[0] * t[0][1] + c[1] * t[1][1]]
                z = sum(x)
                down[id(k)] = [x[0] / z, x[1] / z]
        return out

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, pieces = parse(page)
        p = self.marginals(nodes)
        blocks, line = [], []
        for node, text in [*pieces, (nodes[0], None)]:
            if text is None:
                if b := _SPACE.sub(" ", "".join(line)).strip():
                    blocks.append(b)
                line = []
            elif p[id(node)] >= 0.5:
                line.append(text)
        return "\n\n".join(blocks)


def fit(pages: list[str] = LABELLED) -> Model:
    return Model(pages)


def main_text(spark: SparkSession, model: Model, page: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in it:
            yield pages.map(lambda x: shared.value.extract(x))

    return of(page)


def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "pages").select("page_id", "url", main_text(spark, fit(), F.col("html")).alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))
