"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree."""

from __future__ import annotations

import copy
import html as references
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.boosting import Boosted
from millrace.llm.common import with_text_columns

TRAIN_PAGES = 400  # pages with a marked article that the trees are fitted on: those of the least hash
NODES = 5_000
TRAIN_CHARS = 100_000  # of longer pages nothing is fitted

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+")

# HTML's own element classes: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
HIDDEN = frozenset("svg template noscript".split())  # parsed, and no part of the text
# In svg these begin HTML again, and the tags of the second set hold HTML.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
FOREIGN = frozenset(("foreignobject", "desc"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {  # an opening tag ends an open one of these, up to the stop
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NOTHING: set[str] = set()
PARAGRAPH, KEEPS_PARAGRAPH = {"p"}, {"td", "th", "table", "button", "object"}
ALONE = {t: frozenset((t,)) for t in "html head body div section article main nav header footer aside form p ul ol li h1 h2 h3".split()}
# Names, of tags or in class, id and role, that speak against or for the main text.
AGAINST = frozenset(
    "nav menu navigation header footer aside sidebar form ad ads advert advertisement adverts banner promo sponsor sponsored "
    "cookie consent notice alert popup modal newsletter subscribe signup login search share social related recommended "
    "breadcrumb breadcrumbs pagination pager comment comments reply replies disqus respond toolbar widget copyright legal "
    "button select dialog complementary contentinfo masthead skip tags tagcloud".split()
)
FOR = frozenset("article main content post entry story body text prose".split())
ROOTS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDING = re.compile(r"[.!?;:,]")


@dataclass(slots=True)
class Node:
    """An element that breaks a line, or (with ``text``) a run of text between such breaks."""

    tag: str
    parent: int
    depth: int
    names: frozenset[str] = frozenset()
    text: str | None = None
    linked: int = 0  # characters of the run inside links
    at: int = 0  # place in the page
    children: list[int] = field(default_factory=list)


def _raw_end(page: str, tag: str, at: int) -> int | None:
    stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
    return stop.end() if stop else None


def _hidden_end(page: str, tag: str, at: int, around: list[str], endless: set[int]) -> int:
    """Where the element that opens before ``at`` ends: by its own end tag, nested ones counted, and svg also by that of
    an element ``around`` it or by a tag that begins HTML again. ``at`` if nothing ends it, so that an unclosed one
    hides nothing; such places go to ``endless``.
    """
    held, place = [(tag, at)], at
    while at not in endless and (m := MARKUP.search(page, place)):
        place = m.end()
        name = (m[2] or m[5] or "").lower()
        if m[1] or m[4]:
            if any(t == name for t, _ in held):
                while held.pop()[0] != name:
                    pass
                if not held:
                    return place
            elif name in around and held[0][0] == "svg" and not any(t in ("template", "noscript") for t, _ in held):
                return m.start()
        elif name in RAW:
            place = _raw_end(page, name, place) or place
        elif name in HIDDEN | FOREIGN:
            if held[-1][0] != "svg" and name != "svg" or not (m[3] or m[6] or "").endswith("/"):
                held.append((name, place))
        elif held[-1][0] == "svg" and name in BREAKOUT:
            while held and held[-1][0] == "svg":
                held.pop()
            if not held:
                return m.start()
    endless.update(p for _, p in held)
    return at


def parse(page: str) -> list[Node]:
    """The page's blocks in order, parents before children; scripts, styles, titles, drawings and comments are left out."""
    nodes = [Node("#page", -1, 0)]
    open_at, open_tags = [0], ["#page"]
    run: list[str] = []
    linked = links = 0
    endless: set[int] = set()

    def add(node: Node) -> int:
        nodes.append(node)
        nodes[node.parent].children.append(len(nodes) - 1)
        return len(nodes) - 1

    def close(wanted: set[str], stops: set[str]) -> None:
        for i in range(len(open_tags) - 1, 0, -1):
            if open_tags[i] in wanted:
                del open_at[i:], open_tags[i:]
                return
            if open_tags[i] in stops:
                return

    at, end = 0, len(page)
    while at <= end:
        m = MARKUP.search(page, at)
        start = m.start() if m else end
        if start > at:
            run.append(page[at:start])
            linked += (start - at) * links
        tag = (m[2] or m[5] or "").lower() if m else ""
        if tag in INLINE:
            at = m.end()
            if tag == "a":
                links = 0 if m[1] or m[4] else 1
            elif tag == "br":
                run.append(" ")
            continue
        if m and not tag:
            at = m.end()
            if m[0].startswith("<![CDATA["):
                run.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if run and tag not in RAW and tag not in HIDDEN:
            text = "".join(run)
            text = " ".join((references.unescape(text) if "&" in text else text).split())
            if text:
                add(Node("#text", open_at[-1], len(open_at), text=text, linked=min(linked, len(text)), at=start))
            run.clear()
            linked = 0
        if m is None:
            break
        at = m.end()
        if tag in RAW:
            if not (m[1] or m[4]):
                at = _raw_end(page, tag, at) or end
            continue
        if tag in HIDDEN:
            if not (m[1] or m[4] or tag == "svg" and (m[3] or m[6] or "").endswith("/")):
                at = _hidden_end(page, tag, at, open_tags, endless)
            continue
        if m[1] or m[4]:
            if tag in open_tags:
                close({tag}, NOTHING)
            continue
        if "p" in open_tags:
            close(PARAGRAPH, KEEPS_PARAGRAPH)
        if tag in CLOSES:
            close(*CLOSES[tag])
        attributes = m[3] or m[6] or ""
        names = ALONE.get(tag) or frozenset((tag,))
        if attributes:
            found = {tag}
            for a in ATTRIBUTE.finditer(attributes):
                found.update(PARTS.findall((a[2] or a[3] or a[4] or "").lower()))
            names = frozenset(found)
        node = add(Node(tag, open_at[-1], len(open_at), names, at=start))
        if tag not in VOID and not attributes.endswith("/"):
            open_at.append(node)
            open_tags.append(tag)
    return nodes


def _below(nodes: list[Node], start: int, mark: np.ndarray) -> None:
    todo = [start]
    while todo:
        i = todo.pop()
        mark[i] = True
        todo += nodes[i].children


def labels(nodes: list[Node]) -> np.ndarray | None:
    """Which nodes hold or lie in the marked article and under nothing that speaks against it; None without a mark."""
    roots = [i for i, n in enumerate(nodes) if n.tag in ROOTS or "main" in n.names and n.tag != "#text"]
    if not roots:
        return None
    inside = np.zeros(len(nodes), bool)
    _below(nodes, roots[0], inside)
    for i, n in enumerate(nodes):
        if inside[i] and i != roots[0] and n.names & AGAINST and not n.names & ROOTS:
            out = np.zeros(len(nodes), bool)
            _below(nodes, i, out)
            inside &= ~out
    up = roots[0]
    while up >= 0:
        inside[up] = True
        up = nodes[up].parent
    return inside


FEATURES = 22


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: size and density of its subtree, names on it and above, depth, and its siblings."""
    n = len(nodes)
    chars, linked, tags, runs, marks = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.text is None:
            tags[i] += 1
        else:
            chars[i], linked[i], runs[i], marks[i] = len(node.text), node.linked, 1, len(ENDING.findall(node.text))
        p = node.parent
        if p >= 0:
            chars[p] += chars[i]
            linked[p] += linked[i]
            tags[p] += tags[i]
            runs[p] += runs[i]
            marks[p] += marks[i]
    rows = []
    above, below = [0] * n, [0] * n
    rank = [0.0] * n
    for i, node in enumerate(nodes):
        p = node.parent
        against = favour = False
        if node.names:
            against = not node.names.isdisjoint(AGAINST) and node.names.isdisjoint(ROOTS)
            favour = node.tag != "body" and not node.names.isdisjoint(FOR)
        above[i] = against + (above[p] if p >= 0 else 0)
        below[i] = favour + (below[p] if p >= 0 else 0)
        for k, child in enumerate(node.children):
            rank[child] = k / len(node.children)
        up = nodes[p].tag if p >= 0 else ""
        siblings = len(nodes[p].children) if p >= 0 else 1
        kinds = (node.tag in HEADINGS or up in HEADINGS, "li" in (node.tag, up), "p" in (node.tag, up))
        rows.append((node.text is not None, node.depth, against, favour, above[i], below[i], siblings, rank[i], *kinds, node.at, max(p, 0)))
    given = np.array(rows, float)
    chars, linked, tags, runs, marks = (np.array(a, float) for a in (chars, linked, tags, runs, marks))
    parent = given[:, 12].astype(int)
    x = np.empty((n, FEATURES))
    x[:, :2] = given[:, :2]
    x[:, 2] = np.log1p(chars)
    x[:, 3] = linked / np.maximum(chars, 1)
    x[:, 4] = np.log1p(tags)
    x[:, 5] = np.log1p(chars / np.maximum(tags, 1))
    x[:, 6] = marks / np.maximum(chars, 1)
    x[:, 7:13] = given[:, 2:8]
    x[:, 13] = chars / np.maximum(chars[parent], 1)
    x[:, 14] = linked[parent] / np.maximum(chars[parent], 1)
    x[:, 15] = np.log1p(chars[parent] / np.maximum(runs[parent], 1))
    x[:, 16:19] = given[:, 8:11]
    x[:, 19] = chars / max(chars[0], 1)
    x[:, 20] = given[:, 11] / max(given[:, 11].max(), 1)
    x[:, 21] = np.log1p(chars[parent[parent]])
    return x


def _masked(nodes: list[Node]) -> list[Node]:
    """The page as if its author had used plain blocks for the article."""
    out = copy.deepcopy(nodes)
    for node in out:
        if node.names & FOR:
            node.names = (node.names - FOR) | {"div"}
            node.tag = "div" if node.tag in ROOTS else node.tag
    return out


def _nested(nodes: list[Node]) -> list[Node]:
    """The page with what speaks against the article moved into it, so that trees meet such parts there too."""
    root = next(i for i, n in enumerate(nodes) if n.tag in ROOTS or "main" in n.names and n.tag != "#text")
    below = np.zeros(len(nodes), bool)
    _below(nodes, root, below)
    out = copy.deepcopy(nodes)
    for i, node in enumerate(out):
        # Only parts after the root move, so that parents stay before their children.
        if i > root and not below[i] and node.names & AGAINST and node.parent < root:
            out[node.parent].children.remove(i)
            node.parent = root
            out[root].children.append(i)
    return out


def fit_blocks(pages: DataFrame, html: str = "html", sample: int = TRAIN_PAGES) -> Boosted | None:
    """Trees that tell nodes of the main text, learned from pages whose author marked it (``article`` or ``main``).

    At most ``sample`` pages of at most ``TRAIN_CHARS`` characters come to the driver, those of the least hash of
    their text. Each is fitted on as it is, with its marks taken away, and with boilerplate moved inside. None if
    no page is marked.
    """
    marked = pages.select(F.col(html).alias("html")).where(
        F.col("html").rlike(r"(?i)<(article|main)[\s>]") & (F.length("html") <= TRAIN_CHARS)
    )
    rows = marked.orderBy(F.xxhash64("html"), "html").limit(sample).collect()
    xs, ys = [], []
    for row in rows:
        nodes = parse(row["html"])
        kept = labels(nodes)
        if kept is None:
            continue
        moved = _nested(nodes)
        for version in (nodes, _masked(nodes), moved):
            xs.append(features(version))
            ys.append(labels(version) if version is moved else kept)
    y = np.concatenate(ys).astype(float) if ys else np.empty(0)
    if len(np.unique(y)) < 2:
        return None
    return Boosted().fit(np.concatenate(xs), y)


def decode(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """The likeliest choice of nodes in which nothing below a rejected node is kept.

    From the leaves up, a node's subtree is worth its own log-odds and the better choice of each child if kept,
    and all log-odds against it if not; from the root down, the better choice is taken. Ties keep.
    """
    n = len(nodes)
    keep, drop = logits.copy(), -logits.copy()
    children = sorted(range(1, n), key=lambda i: -nodes[i].depth)
    for i in children:
        p = nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = np.zeros(n, bool)
    todo = [0] if n else []
    kept[:1] = True  # the page itself is no choice
    while todo:
        i = todo.pop()
        for c in nodes[i].children:
            if keep[c] >= drop[c]:
                kept[c] = True
                todo.append(c)
    return kept


def main_texts(pages: Iterable[str | None], model: Boosted | None) -> Iterator[str]:
    """The main text of each page: kept runs in page order, joined by one space.

    Trees are asked for the nodes of many pages at once, at least ``NODES`` of them.
    """

    def given(held: list[tuple[list[Node], np.ndarray]]) -> Iterator[str]:
        x = np.concatenate([f for _, f in held])
        # Without a model: what speaks against the main text is rejected, all else is kept.
        logits = model.logits(x) if model else np.where(x[:, 9] > 0, -1.0, 1.0)
        at = 0
        for nodes, _ in held:
            kept = decode(nodes, logits[at : at + len(nodes)])
            at += len(nodes)
            yield " ".join(node.text for node, keep in zip(nodes, kept, strict=True) if keep and node.text is not None)

    held, size = [], 0
    for page in pages:
        nodes = parse(page or "")
        held.append((nodes, features(nodes)))
        size += len(nodes)
        if size >= NODES:
            yield from given(held)
            held, size = [], 0
    if held:
        yield from given(held)


def extract_text(pages: DataFrame, model: Boosted | None, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in column ``text``, in place of ``html``.

    The whole page is read. White space inside a block is one space, blocks are joined by one space, character
    references are decoded once. Null and empty pages, and those without any main text, give an empty text;
    broken markup is read as a browser would, as far as blocks go. Rows are independent: repeated rows, null ids
    and extra columns pass through, a column named ``text`` is replaced.
    """

    def make():
        return lambda texts: [(t,) for t in main_texts(texts, model)]

    added = T.StructType([T.StructField(text, T.StringType())])
    return with_text_columns(pages, html, make, added, keep_text=False, many=True)
