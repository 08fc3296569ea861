"""Main text of web pages: boosted trees over DOM nodes, decoded so that the tree makes sense.

Each node gets features: its tag, groups of words in its attributes and its ancestors', the density of
text, links and sentences in its subtree, depth, place among siblings and their statistics. Gradient-boosted
trees give the probabilities of three states: around the content (a wrapper), inside it, or
cut. A dynamic programme over the tree picks the likeliest consistent states: below a cut node
all is cut, below a content node are content and cut nodes only, and wrappers stand below wrappers.
The text of content nodes is the result.

The trees are trained on generated pages of known structure (``html_training``), once in a driver process.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.dom import Node, blocks, parse

AROUND, INSIDE, CUT = 0, 1, 2
#: Nodes classified at once; a page's nodes stay together.
NODES = 20_000
TAGS = ["html", "body", "main", "article", "section", "div", "p", "h1", "h2", "ul", "table", "blockquote", "pre", "figure", "nav", "header", "footer", "aside", "form", "li", "span", "address", "other"]
_TAG_OF = {t: i for i, t in enumerate(TAGS)} | {"h3": 8, "h4": 8, "h5": 8, "h6": 8, "ol": 9, "dl": 9, "menu": 14, "tr": 10, "td": 10, "th": 10, "fieldset": 18, "search": 18, "dialog": 17, "figcaption": 13, "hgroup": 15}
# Groups of attribute words.
GROUPS = {
    "content": "article articlebody content entry main post story text body prose hentry markdown page blog news read",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc topbar pagination pager links tabs skip toolbar",
    "head": "header masthead banner logo branding top hero",
    "foot": "footer foot copyright colophon bottom legal contentinfo",
    "side": "sidebar side aside related widget rail recommended recommendations trending popular more complementary teaser also",
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner adsense dfp outbrain taboola",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe subscription gdpr overlay paywall banner toast signup disclaimer warning",
    "comment": "comment comments reply replies disqus discussion respond commentlist thread reviews",
    "social": "share sharing social follow facebook twitter like buttons",
    "form": "form login search searchbox signin register contact input",
    "meta": "byline author meta date time published tags category info credit",
}
_GROUP_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(GROUPS.values()):
    for _w in _words.split():
        _GROUP_OF.setdefault(_w, []).append(_i)
_NG, _NT = len(GROUPS), len(TAGS)
#: Columns that attribute words are hashed into, known words and others.
HASHED = 64
_TAG_CUTS = {"nav": 1, "header": 2, "footer": 3, "aside": 4, "form": 9, "article": 0, "main": 0}
NUMBERS = [
    "chars", "direct", "link_share", "links", "stops_per", "commas_per", "paras", "items", "inputs", "depth", "place", "siblings", "share_page", "share_parent",
    "before", "kids", "mean_piece", "sib_chars", "sib_same", "prev_chars", "next_chars", "in_article", "page_has_article", "page_chars", "hidden", "best_para", "words",
]
#: Elements that are never content on their own.
NEVER = frozenset("nav footer aside form button menu dialog search".split())
N_FEATURES = _NT + 2 * _NG + HASHED + len(NUMBERS)


def node_features(nodes: list[Node]) -> np.ndarray:
    """(nodes, features) of one page."""
    n = len(nodes)
    x = np.zeros((n, N_FEATURES), np.float32)
    sums = np.array([(v.chars, v.linked, v.links, v.stops, v.commas, v.paras, v.items, v.inputs, v.pieces, 0) for v in nodes], np.float64)
    direct = sums[:, 0].copy()
    parent = np.array([v.parent for v in nodes])
    tag = np.array([_TAG_OF.get(v.tag, _NT - 1) for v in nodes])
    before = np.concatenate([[0.0], np.cumsum(direct)[:-1]])
    rows = sums.tolist()
    # what stands above a node: attribute groups and telling tags, added up along its ancestors
    above: list[np.ndarray | None] = [None] * n
    inside = np.zeros(n, np.float32)
    own = np.zeros((n, _NG), np.float32)
    for i, v in enumerate(nodes):
        for w in v.words:
            x[i, _NT + 2 * _NG + _column(w)] += 1
            for g in _GROUP_OF.get(w, ()):
                own[i, g] += 1
        if i:
            p = v.parent
            up, name = above[p], nodes[p].tag
            g = _TAG_CUTS.get(name)
            if nodes[p].words or g is not None:
                mine = own[p].copy()
                if g is not None:
                    mine[g] += 1
                if mine.any():
                    up = np.minimum(mine if up is None else up + mine, 3)
            above[i] = up
            inside[i] = inside[p] or name in ("article", "main")
            if up is not None:
                x[i, _NT + _NG : _NT + 2 * _NG] = up
    for i in range(n - 1, 0, -1):
        a, b = rows[nodes[i].parent], rows[i]
        for k in range(9):
            a[k] += b[k]
        best = max(b[9], direct[i] if nodes[i].tag == "p" else 0.0)
        if best > a[9]:
            a[9] = best
    total = np.array(rows)
    chars = np.maximum(total[:, 0], 1)
    page = max(total[0, 0], 1.0)
    place, sib, same, prev, following, mean = _siblings(parent, np.array([hash_of(v.tag) for v in nodes]), total[:, 0])
    x[np.arange(n), tag] = 1
    x[:, _NT : _NT + _NG] = own
    share_parent = total[:, 0] / chars[np.maximum(parent, 0)]
    has_article = any(v.tag in ("article", "main") for v in nodes)
    cols = [
        np.log1p(total[:, 0]), np.log1p(direct), total[:, 1] / chars, np.log1p(total[:, 2]), total[:, 3] / chars * 100, total[:, 4] / chars * 100,
        np.log1p(total[:, 5]), np.log1p(total[:, 6]), total[:, 7], [v.depth for v in nodes], place, np.log1p(sib), total[:, 0] / page, share_parent,
        before / page, np.log1p([len(v.kids) for v in nodes]), np.log1p(total[:, 0] / np.maximum(total[:, 8], 1)), np.log1p(mean), np.log1p(same), np.log1p(prev), np.log1p(following),
        inside, np.full(n, has_article), np.full(n, np.log1p(page)), [v.hidden for v in nodes], np.log1p(total[:, 9]), [len(v.words) for v in nodes],
    ]
    for k, c in enumerate(cols):
        x[:, N_FEATURES - len(cols) + k] = c
    return x


@lru_cache(maxsize=4096)
def hash_of(word: str) -> int:
    return zlib.crc32(word.encode())


def _column(word: str) -> int:
    return hash_of(word) % HASHED


def _siblings(parent: np.ndarray, tag: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place among siblings, their number, those of equal tag, and the text of the one before, the one after and the mean one."""
    n = len(parent)
    place, sib, same, prev, following, mean = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    order = np.argsort(parent, kind="stable")[1:]  # without the root
    if not len(order):
        return place, sib, same, prev, following, mean
    group = parent[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(order)))
    at = np.repeat(np.arange(len(first)), size)
    place[order] = (np.arange(len(order)) - first[at]) / size[at]
    sib[order] = size[at]
    mean[order] = (np.add.reduceat(chars[order], first) / size)[at]
    together = group[1:] == group[:-1]
    prev[order[1:][together]] = chars[order[:-1][together]]
    following[order[:-1][together]] = chars[order[1:][together]]
    _, kind, times = np.unique((at.astype(np.int64) << 32) | tag[order], return_inverse=True, return_counts=True)
    same[order] = times[kind]
    return place, sib, same, prev, following, mean


class Forest:
    """Boosted trees for several classes; complete trees stored level by level."""

    BINS, DEPTH, ROUNDS, STEP, RIDGE = 24, 4, 36, 0.25, 1.0

    def __init__(self, classes: int):
        self.classes = classes
        self.edges: list[np.ndarray] = []
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def _leaves(self, b: np.ndarray, t: int) -> np.ndarray:
        at = np.zeros(len(b), np.int64)
        rows = np.arange(len(b))
        for _ in range(self.DEPTH):
            at = 2 * at + 1 + (b[rows, self.feature[t][at]] >= self.cut[t][at])
        return at - (2**self.DEPTH - 1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.zeros((len(x), self.classes))
        for t in range(len(self.leaf)):
            out[:, t % self.classes] += self.leaf[t][self._leaves(b, t)]
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        m = self.margins(x)
        m -= m.max(axis=1, keepdims=True)
        return m - np.log(np.exp(m).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        self.edges = [np.unique(np.quantile(x[:, i], np.arange(1, self.BINS) / self.BINS)).astype(np.float32) for i in range(x.shape[1])]
        # a value seldom seen still gets a bin of its own
        self.edges = [np.unique(np.append(e, np.float32(1e-6))) if (x[:, i] >= 0).all() else e for i, e in enumerate(self.edges)]
        b = self.bins(x)
        n, f = b.shape
        wide = self.BINS + 1
        margin = np.zeros((n, self.classes))
        spot = b.astype(np.int64) + np.arange(f) * wide
        for _ in range(self.ROUNDS):
            p = np.exp(margin - margin.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for c in range(self.classes):
                g, h = p[:, c] - (y == c), np.maximum(p[:, c] * (1 - p[:, c]), 1e-4)
                feature, cut = np.zeros(2**self.DEPTH - 1, np.int64), np.full(2**self.DEPTH - 1, 255, np.int64)
                at = np.zeros(n, np.int64)
                for level in range(self.DEPTH):
                    first, width = 2**level - 1, 2**level
                    cell = ((at - first)[:, None] * (f * wide) + spot).ravel()
                    hg = np.bincount(cell, weights=np.repeat(g, f), minlength=width * f * wide).reshape(width, f, wide)
                    hh = np.bincount(cell, weights=np.repeat(h, f), minlength=width * f * wide).reshape(width, f, wide)
                    cg, ch = np.cumsum(hg, axis=2)[:, :, :-1], np.cumsum(hh, axis=2)[:, :, :-1]
                    tg, th = hg.sum(axis=2, keepdims=True), hh.sum(axis=2, keepdims=True)
                    gain = cg**2 / (ch + self.RIDGE) + (tg - cg) ** 2 / (th - ch + self.RIDGE) - tg**2 / (th + self.RIDGE)
                    gain[(ch < 1) | (th - ch < 1)] = 0
                    flat = gain.reshape(width, -1)
                    best = flat.argmax(axis=1)
                    ok = flat[np.arange(width), best] > 1e-6
                    feature[first : first + width] = np.where(ok, best // (wide - 1), 0)
                    cut[first : first + width] = np.where(ok, best % (wide - 1) + 1, 255)
                    at = 2 * at + 1 + (b[np.arange(n), feature[at]] >= cut[at])
                leaf = at - (2**self.DEPTH - 1)
                size = 2**self.DEPTH
                value = -self.STEP * np.bincount(leaf, weights=g, minlength=size) / (np.bincount(leaf, weights=h, minlength=size) + self.RIDGE)
                self.feature.append(feature)
                self.cut.append(cut)
                self.leaf.append(value)
                margin[:, c] += value[leaf]
        return self


@lru_cache(maxsize=1)
def default_forest() -> Forest:
    """The forest trained on generated pages, the same in every process."""
    from noteloom.llm.html_training import training_set

    return Forest(3).fit(*training_set())


def decode(nodes: list[Node], logp: np.ndarray) -> list[int]:
    """The likeliest states in which no node contradicts its ancestors."""
    n = len(nodes)
    score = logp.tolist()
    for i in range(n - 1, 0, -1):
        a, b = score[nodes[i].parent], score[i]
        inner = b[INSIDE] if b[INSIDE] > b[CUT] else b[CUT]
        a[AROUND] += b[AROUND] if b[AROUND] > inner else inner
        a[INSIDE] += inner
        a[CUT] += b[CUT]
    state = [0] * n
    root = score[0]
    state[0] = AROUND if root[AROUND] >= root[INSIDE] else INSIDE
    for i in range(1, n):
        b, up = score[i], state[nodes[i].parent]
        if up == CUT:
            state[i] = CUT
        elif up == INSIDE:
            state[i] = INSIDE if b[INSIDE] >= b[CUT] else CUT
        else:
            state[i] = max((AROUND, INSIDE, CUT), key=b.__getitem__)
    return state


def rescued(nodes: list[Node], pieces: list[tuple[int, str]], logp: np.ndarray) -> list[int]:
    """States for a page of which nothing would be kept: the likeliest subtree with text that isn't mostly links or a menu, form or the like is content."""
    score = logp.tolist()
    text, linked, barred = [0] * len(nodes), [0] * len(nodes), [False] * len(nodes)
    for i, v in enumerate(nodes):
        barred[i] = v.hidden or v.tag in NEVER or (i > 0 and barred[v.parent])
    for i in range(len(nodes) - 1, -1, -1):
        text[i] += nodes[i].chars
        linked[i] += nodes[i].linked
        if i:
            p = nodes[i].parent
            text[p] += text[i]
            linked[p] += linked[i]
            inner = max(score[i][INSIDE], score[i][CUT])
            score[p][INSIDE] += inner
            score[p][CUT] += score[i][CUT]
    fit = [i for i in range(len(nodes)) if text[i] and not barred[i] and 2 * linked[i] < text[i]]
    state = [CUT] * len(nodes)
    if fit:
        best = max(fit, key=lambda i: (score[i][INSIDE] - score[i][CUT], -i))
        own = {best}
        state[best] = INSIDE
        for i in range(best + 1, len(nodes)):
            if nodes[i].parent in own:
                own.add(i)
                if state[nodes[i].parent] == INSIDE and score[i][INSIDE] >= score[i][CUT]:
                    state[i] = INSIDE
    return state


def extract_pages(pages: list[str | None], forest: Forest) -> list[str]:
    """Main texts of whole pages; null or empty pages give ''. Nodes of some pages at once are classified together."""
    out: list[str] = []
    held: list[tuple[list[Node], list[tuple[int, str]]]] = []
    size = 0

    def flush() -> None:
        feats = [node_features(nodes) for nodes, _ in held if nodes]
        logp = forest.log_probabilities(np.concatenate(feats)) if feats else np.zeros((0, 3))
        at = 0
        for nodes, pieces in held:
            state = decode(nodes, logp[at : at + len(nodes)]) if nodes else []
            at += len(nodes)
            text = blocks(pieces, [s == INSIDE for s in state])
            if not text and pieces:
                text = blocks(pieces, [s == INSIDE for s in rescued(nodes, pieces, logp[at - len(nodes) : at])])
            out.append(text)
        held.clear()

    for page in pages:
        held.append(parse(page) if page else ([], []))
        size += len(held[-1][0])
        if size >= NODES:
            flush()
            size = 0
    flush()
    return out


def extract(pages: DataFrame, forest: Forest | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page.

    Input columns: page_id, url, html; others are ignored. Null or empty html gives an empty text. Pages may be
    malformed, end anywhere, or hold no tags at all; where all text would be cut, the likeliest part that isn't a menu or a form stays. Texts of
    any length are read whole, in time in proportion to them. Repeated rows give repeated results, null ids and urls stay, an empty table
    gives an empty result.
    """
    model = forest or default_forest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(2).to_pylist()
            for lo in range(0, len(html), 256):
                texts = extract_pages(html[lo : lo + 256], model)
                cols = [batch.column(i).slice(lo, len(texts)) for i in range(2)]
                cols += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
