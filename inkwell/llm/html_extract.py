"""HTML main text by minimum cut.

A page becomes a row of text blocks. A logistic classifier over shallow
features (length, links, punctuation, tag, place) prices both labels of each
block; the prices are the capacities to the source (content) and to the sink
(boilerplate). Neighbours in reading order and blocks that are close in the
document tree are joined by edges that cost what it costs to label them apart.
The minimum cut is the cheapest labelling, found by maximum flow.

The classifier is trained on weak labels: on pages that mark their parts
(article, main; nav, footer, header, aside), these marks are the labels but not
features. Where a page has such marks, they shift the prices by ``MARK``.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.storage import prepare

#: Pages that training sees at most, by the hash of their id; all pages are labelled whole.
TRAIN_PAGES = 600
ADJACENT = 0.8  # cost of a change between neighbours in reading order
NEAR = 0.8  # of blocks with one parent; halved with each further step in the tree
STEPS = 4  # levels up from a block within which its neighbour counts as near
MARK = 2.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|title|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_GOOD = frozenset(("article", "main"))
_BAD = frozenset(("nav", "footer", "header", "aside", "menu", "form", "button", "select"))
_BAD_CLASS = re.compile(r"(?:^|[\s\"'=_-])(?:ads?|advert\w*|banner|sidebar|menu|navbar|footer|cookie\w*|promo|breadcrumbs?|related|social|share)(?=$|[\s\"'_-])", re.I)
_CLASS = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[^\W_]+")


@dataclass(slots=True)
class Block:
    text: str
    node: int  # its element
    parent: int  # the element's parent
    depth: int
    shared: int  # depth of the deepest element that holds this block and the one before
    tag: str
    words: int
    linked: int
    mark: int  # 1 in an article, -1 in navigation and the like, 0 unmarked


def blocks(source: str) -> list[Block]:
    """Text blocks of a page; broken markup never fails."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, node, mark
    opened: dict[str, list[int]] = {}  # depths of the open elements by tag
    nodes, links, pieces, link_words, low = 0, 0, [], 0, 0
    at = 0

    def close() -> None:
        nonlocal pieces, link_words, low
        if not pieces:
            return
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, stack[-1][1], stack[-2][1] if len(stack) > 1 else -1, len(stack) - 1, low, stack[-1][0], len(_WORD.findall(text)), link_words, stack[-1][2]))
            low = len(stack) - 1
        pieces, link_words = [], 0

    def drop(depth: int) -> None:
        """Closes all elements from a depth on."""
        nonlocal low
        while len(stack) > depth:
            opened[stack.pop()[0]].pop()
        low = min(low, len(stack) - 1)

    def say(text: str) -> None:
        nonlocal link_words
        pieces.append(text)
        if links:
            link_words += len(_WORD.findall(text))

    for m in _TOKEN.finditer(source):
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "a":
                links = max(0, links + (-1 if m.group(2) else 1))
            continue
        if name == "br":
            pieces.append(" ")
            continue
        close()
        if m.group(2):
            if opened.get(name):
                drop(opened[name][-1])
                links = 0
            continue
        if name in _VOID or m.group(4).endswith("/"):
            continue
        if (name in _CLOSES_P and stack[-1][0] == "p") or (name == stack[-1][0] and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
            drop(len(stack) - 1)
        mark = stack[-1][2]
        if name in _GOOD:
            mark = 1
        elif name in _BAD or (m.group(4) and any(_BAD_CLASS.search(c) for c in _CLASS.findall(m.group(4)))):
            mark = -1
        nodes += 1
        opened.setdefault(name, []).append(len(stack))
        stack.append((name, nodes, mark))
    if at < len(source):
        say(source[at:])
    close()
    return out


TAGS = ("p", "li", "h", "td", "div", "other")


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    x = np.zeros((n, 9 + len(TAGS)))
    for i, b in enumerate(found):
        w = max(b.words, 1)
        ends = sum(b.text.count(c) for c in ".!?")
        x[i, :9] = (np.log1p(b.words), b.linked / w, ends / w, b.text[-1:] in ".!?\"", len(b.text) / w / 10, b.words < 4, i / max(n - 1, 1), i == 0, i == n - 1)
        tag = b.tag if b.tag in TAGS else "h" if re.fullmatch("h[1-6]", b.tag) else "other"
        x[i, 9 + TAGS.index(tag)] = 1
    return x


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def log_odds(self, found: list[Block]) -> np.ndarray:
        """Of content against boilerplate; marks included."""
        z = features(found) @ self.weights + self.bias
        return np.clip(z, -4, 4) + MARK * np.array([b.mark for b in found])


DEFAULT = Model(np.array([0.9, -4.0, 2.0, 0.5, 0.0, -0.8, 0.0, -0.3, -0.3, 0.5, -0.8, 0.3, 0.0, 0.0, 0.0]), -1.5)


def fit(pages: list[str]) -> Model:
    """Ridge logistic regression on the marked blocks; without both kinds a fixed model."""
    xs, ys = [], []
    for p in pages:
        found = blocks(p or "")
        marks = np.array([b.mark for b in found])
        if len(found) and (marks != 0).any():
            xs.append(features(found)[marks != 0])
            ys.append(marks[marks != 0] > 0)
    if not xs:
        return DEFAULT
    x, y = np.concatenate(xs), np.concatenate(ys).astype(float)
    if y.min() == y.max():
        return DEFAULT
    d = np.c_[x, np.ones(len(x))]
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, ridge = np.zeros(d.shape[1]), np.full(d.shape[1], 2e-3)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = d.T @ (share * (p - y)) + ridge * w
        h = (d * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ d + np.diag(ridge)
        w = w - np.linalg.solve(h, g)
    return Model(w[:-1], float(w[-1]))


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """(i, j, cost): neighbours in reading order, dearer the nearer they are in the tree, and each block with the last one before it whose element has the same parent, past what stands between them."""
    out: dict[tuple[int, int], float] = {}
    under: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            cost, up = ADJACENT, b.depth - b.shared
            if up < STEPS:
                cost += NEAR * 0.5 ** max(up, found[i - 1].depth - b.shared)
            out[i - 1, i] = cost
        j = under.get(b.parent)
        if j is not None and j < i - 1:
            out[j, i] = NEAR * 0.5
        under[b.parent] = i
    return [(i, j, c) for (i, j), c in out.items()]


def minimum_cut(odds: np.ndarray, joined: list[tuple[int, int, float]]) -> np.ndarray:
    """True for the blocks on the source's side of the least cut; of several least cuts the one with the fewest such blocks."""
    n = len(odds)
    label = odds > 0
    if all(label[i] == label[j] for i, j, _ in joined):
        return label  # each block has its cheaper label and no edge is cut: nothing is cheaper
    s, t = n, n + 1
    head, to, cap = [[] for _ in range(n + 2)], [], []

    def link(a: int, b: int, c: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(c)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, z in enumerate(odds.tolist()):
        if z > 0:
            link(s, i, z, 0.0)
        elif z < 0:
            link(i, t, -z, 0.0)
    for i, j, c in joined:
        link(i, j, c, c)
    eps = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return np.array([level[i] >= 0 for i in range(n)], bool)
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:  # blocking flow, without recursion
            if a == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                k = next(k for k, e in enumerate(path) if cap[e] <= eps)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[a] < len(head[a]):
                e = head[a][nxt[a]]
                if cap[e] > eps and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(head[a]):
                path.append(e)
                a = to[e]
            elif path:
                a = to[path.pop() ^ 1]
                nxt[a] += 1
            else:
                break


def extract(source: str, model: Model) -> tuple[str, int, int]:
    """(content, blocks kept, blocks)."""
    found = blocks(source)
    if not found:
        return "", 0, 0
    keep = minimum_cut(model.log_odds(found), edges(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k), int(keep.sum()), len(found)


def train(pages: DataFrame) -> Model:
    """Fits on at most TRAIN_PAGES pages by the hash of page_id; null ids and pages aren't used."""
    ids = pages.select(F.col("page_id").cast("long").alias("page_id")).where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(TRAIN_PAGES)
    got = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where("html is not null").join(F.broadcast(ids), "page_id")
    rows = got.groupBy("page_id").agg(F.min("html").alias("html")).toArrow().sort_by("page_id")
    return fit(rows["html"].to_pylist())


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, text, n_kept, n_blocks) of every page.

    Blocks of the main text, one a line. Null and empty pages, and pages
    without content, give an empty text; a null id is reported as null;
    repeated rows give equal rows. Other columns aren't read.
    """
    spark = pages.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                got = [extract(h or "", shared.value) for h in part.column(1).to_pylist()]
                yield pa.record_batch(
                    [part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], ["page_id", "text", "n_kept", "n_blocks"]
                )

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string, n_kept int, n_blocks int")
