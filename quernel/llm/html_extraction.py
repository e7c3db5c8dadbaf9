"""Main text of web pages by minimum cut.

A page becomes a row of text blocks, in page order. A classifier gives each block
a cost for either label: a logistic regression on what the block is (length, share
of links, end of sentence, element) and on what holds it (elements, roles, parts of
class and id names), fitted to made-up pages that are labelled by construction
(`html_samples`; the same on every run). The costs, its log-odds, are terminal
capacities: source to block for content, block to sink for boilerplate. Neighbours
in page order, and blocks that follow one another in the same parent or grandparent,
are joined by smoothness edges, weaker with distance in the tree, of the size of an
uncertain block's cost. Maximum flow cuts the graph where the sum of overruled costs
and cut edges is least; what stays with the source is content.

Blocks whose own costs outweigh all their edges are settled first, which leaves
the minimum as it is; the flow runs on what is left. Of several minimum cuts the
one with the fewest content blocks is taken.

Parsing is forgiving: unclosed and stray tags, cut-off pages and bare ``<`` are
text or closed where HTML closes them. Scripts, styles, forms' controls, templates
and what the head holds never become blocks.

Defined cases: a null page counts as empty, and an empty page has an empty text;
pages that are alike get alike texts, whatever their ids; pages of any length are
read whole; an empty table gives an empty result; a row keeps its url, null or not;
other columns don't matter, whatever their names.
"""

from __future__ import annotations

import re
from collections import deque
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import html_samples
from .common import lean
from .html_samples import NAMES

#: Elements of HTML by what they do to a text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
DROPPED = frozenset("head select option button datalist object canvas audio video map dialog".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element of the first kind ends where one of the second starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
BOUNDARY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "p": {"button", "td", "th", "caption", "object"}}
#: Elements and roles that tell what they hold.
LANDMARKS = frozenset("article main nav header footer aside form fieldset section table ul ol blockquote figure menu address details".split())
ROLES = frozenset("main article navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
TOLD = frozenset("h1 h2 h3 h4 p li td th div span label figcaption blockquote pre body section article".split())
KNOWN = frozenset(x for names in NAMES.values() for x in names)

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
NAMES_OF = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")

W_NEXT, W_PARENT, W_GRANDPARENT = 0.3, 0.5, 0.2
#: Pages that the classifier is fitted to, its ridge, and the largest cost.
PAGES, RIDGE, MOST = 500, 1.0, 6.0


class Block:
    __slots__ = ("text", "linked", "tag", "held", "parent", "grandparent")


class _Open:
    """An open element. held: what is known of it and all that holds it; block: the nearest element that isn't inline, itself perhaps; above: the next such one."""

    __slots__ = ("tag", "held", "number", "block", "above")

    def __init__(self, tag: str, held: frozenset, number: int, above: _Open | None):
        self.tag, self.held, self.number = tag, held, number
        inline = tag in INLINE and above is not None
        self.block = above.block if inline else self
        self.above = above.block if above is not None else self


def _open(tag: str, attributes: str, above: _Open, number: int) -> _Open:
    if tag in ("html", "body"):
        return _Open(tag, above.held, number, above)
    held, new = above.held, set()
    if tag in LANDMARKS:
        new.add("header in article" if tag == "header" and "<article" in held else f"<{tag}")
    if attributes and "=" in attributes:
        for kind, a, b, c in NAMES_OF.findall(attributes):
            value = a or b or c
            if kind.lower() == "role":
                new.update(f"role {x}" for x in value.lower().split() if x in ROLES)
            else:
                new.update(f".{x}" for x in map(str.lower, PARTS.findall(value)) if x in KNOWN)
    if not new:
        return _Open(tag, held, number, above)
    if new & {"<article", "<main", "role main", "role article"}:
        # what holds an article tells less of its blocks than what the article holds
        held = frozenset(x if x[0] == "~" else f"~{x}" for x in held if x not in ("<article", "<main"))
    return _Open(tag, held | new, number, above)


def parse(html: str) -> list[Block]:
    """The text blocks of a page."""
    out: list[Block] = []
    stack = [_Open("", frozenset(), 0, None)]
    text: list[str] = []
    links: list[str] = []
    in_link = dropped = number = 0
    opened: dict[str, int] = {}

    def flush():
        nonlocal text, links
        if text:
            joined = SPACE.sub(" ", unescape("".join(text))).strip(" ")
            if joined:
                b = Block()
                b.text, b.linked = joined, len(unescape("".join(links)))
                own = stack[-1].block
                b.tag, b.held = own.tag, stack[-1].held
                b.parent, b.grandparent = own.above.number, own.above.above.number
                out.append(b)
            text, links = [], []

    def close_to(k: int):
        nonlocal in_link, dropped
        for e in stack[k:]:
            opened[e.tag] -= 1
            in_link -= e.tag == "a"
            dropped -= e.tag in DROPPED
        del stack[k:]

    def last(tags, stop=()):
        if not any(opened.get(t) for t in tags):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in stop:
                return 0
        return 0

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        piece = html[at : m.start() if m else end]
        if piece and not dropped:
            text.append(piece)
            if in_link:
                links.append(piece)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag in RAW or tag in VOID:
                if tag == "br" and not dropped:
                    text.append(" ")
                continue
            k = last((tag,))
            if tag not in INLINE:
                flush()
            if k:
                close_to(k)
            continue
        if tag in RAW:
            if tag not in ("svg", "math"):
                flush()
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID:
            if not dropped and tag in ("br", "hr"):
                if tag == "hr":
                    flush()
                else:
                    text.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P and (k := last(("p",), BOUNDARY["p"])):
                close_to(k)
            for ended, starts in ENDS.items():
                if tag in starts and (k := last((ended,), BOUNDARY[ended])):
                    close_to(k)
        if tag == "body" and (k := last(("head",))):
            close_to(k)
        if tag == "a":
            if k := last(("a",)):
                close_to(k)
            in_link += 1
        number += 1
        dropped += tag in DROPPED
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(_open(tag, attributes, stack[-1], number))
    flush()
    return out


def traits(b: Block) -> frozenset:
    """What the classifier knows of a block."""
    n, share = b.text.count(" ") + 1, b.linked / max(1, len(b.text))
    own = {f"words {min(7, n.bit_length())}", f"links {min(3, int(4 * share))}", f"is {b.tag}" if b.tag in TOLD else "is other", "ends" if b.text[-1] in ".!?\"'”’:;。" else "open"}
    if "©" in b.text:
        own.add("copyright")
    return b.held | own


@cache
def classifier() -> dict[str, float]:
    """A weight a trait, and the constant: logistic regression by Newton's steps on PAGES made-up pages. Block texts are looked up in the pages' labels in order."""
    rows, labels = [], []
    for seed in range(PAGES):
        html, truth = html_samples.page(seed)
        blocks = parse(html)
        if [b.text for b in blocks] == [t for t, _ in truth]:
            rows += [traits(b) for b in blocks]
            labels += [y for _, y in truth]
    names = sorted(set().union(*rows))
    place = {x: i + 1 for i, x in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    x[:, 0] = 1
    for i, t in enumerate(rows):
        x[i, [place[k] for k in t]] = 1
    y, w = np.array(labels, float), np.zeros(len(names) + 1)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + RIDGE * w)
    return {"": float(w[0]), **{k: float(w[i]) for k, i in place.items()}}


def content_cost(b: Block, weights: dict[str, float]) -> float:
    """How much more it costs to call a block boilerplate than to call it content: its log-odds, MOST at most."""
    odds = weights[""] + sum(weights.get(t, 0.0) for t in traits(b))
    return max(-MOST, min(MOST, odds))


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges: dict[tuple[int, int], float] = {}
    by_parent: dict[int, int] = {}
    by_grandparent: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] = edges.get((i - 1, i), 0.0) + W_NEXT
        for seen, key, w in ((by_parent, b.parent, W_PARENT), (by_grandparent, b.grandparent, W_GRANDPARENT)):
            if key in seen:
                edges[seen[key], i] = edges.get((seen[key], i), 0.0) + w
            seen[key] = i
    return [(i, j, w) for (i, j), w in edges.items()]


def minimum_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: least sum of overruled costs and cut edges, fewest nodes among equals."""
    n = len(cost)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    cost, label = list(cost), [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(cost[i]) > sum(near[i].values()) + 1e-9:
            label[i] = cost[i] > 0
            for j, w in near[i].items():
                cost[j] += w if label[i] else -w
                near[j].pop(i)
                if label[j] is None:
                    queue.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        place = {i: k for k, i in enumerate(left)}
        inside = [{place[j]: w for j, w in near[i].items() if label[j] is None} for i in left]
        for i, keep in zip(left, _flow([cost[i] for i in left], inside), strict=True):
            label[i] = keep
    return label


def _flow(cost: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow by blocking flows on levels; nodes that the source still reaches."""
    n = len(cost)
    source, sink, eps = n, n + 1, 1e-9
    room: list[dict[int, float]] = [dict(d) for d in near] + [{}, {}]
    for i, c in enumerate(cost):
        if c > 0:
            room[source][i], room[i][source] = c, 0.0
        elif c < 0:
            room[i][sink], room[sink][i] = -c, 0.0
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, r in room[u].items():
                if r > eps and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        todo = [iter(list(d)) for d in room]
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                pushed = min(room[a][b] for a, b in zip(path, path[1:]))
                cut = None
                for k, (a, b) in enumerate(zip(path, path[1:])):
                    room[a][b] -= pushed
                    room[b][a] = room[b].get(a, 0.0) + pushed
                    if cut is None and room[a][b] <= eps:
                        cut = k
                del path[cut + 1 :]
                continue
            for v in todo[u]:
                if room[u][v] > eps and level[v] == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                level[u] = -1


def labelled(html: str | None, weights: dict[str, float]) -> list[tuple[Block, bool, bool]]:
    """(block, what its own cost says, what the cut says) of a page, True for content."""
    blocks = parse(html or "")
    costs = [content_cost(b, weights) for b in blocks]
    return [(b, c > 0, k) for b, c, k in zip(blocks, costs, minimum_cut(costs, smoothness(blocks)), strict=True)]


def extract(html: str | None, weights: dict[str, float] | None = None) -> str:
    return "\n".join(b.text for b, _, k in labelled(html, weights or classifier()) if k)


def extract_pages(df: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    weights = classifier()

    def run(batches):
        for b in batches:
            texts = [extract(h, weights) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(df.dtypes)
    return df.select(id_col, url_col, html_col).mapInArrow(lean(run), f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
