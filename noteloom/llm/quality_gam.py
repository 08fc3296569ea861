"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles of the training rows. Boosting visits the features in
turn; each visit fits a tree of at most three splits to the gradient histogram of one feature's bins and
adds a small step of it to that feature's lookup table. When the main effects are learned, the pairs of
features with the largest gain on what is left get two-way tables, boosted in turn as well. A
score is the logistic function of an intercept plus one table entry for each feature and pair, looked up
for whole batches at once.

The model is fitted on the driver from a bounded sample of labelled rows (``TRAIN_ROWS``); features
come from whole texts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import row_slices, text_buffers
from noteloom.llm.quality_rules import counts_of
from noteloom.llm.textvec import row_hash, span_hash, word_spans

#: Labelled rows used at most, those of least hash of doc_id.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, STEP, RIDGE, MIN_ROWS = 120, 60, 0.08, 1.0, 8
FEATURES = [
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "adjacent", "distinct", "lines", "stops", "commas",
    "bangs", "upper", "digits", "wide", "short", "long", "controls", "first_upper", "word_spread", "top_word",
]


def _class(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _class(range(65, 91)), _class(range(48, 58))
_LETTER = _class([*range(65, 91), *range(97, 123), *range(128, 256)])
_STOP, _COMMA, _BANG = _class(b"."), _class(b",;:"), _class(b"!?")
_WIDE, _CONTROL = _class(range(192, 256)), _class([*range(0, 9), *range(14, 32), 127])


def features_of(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, features) of the texts of a buffer; texts without words are zero but for what they have."""
    n = len(offs) - 1
    out = np.zeros((n, len(FEATURES)), np.float32)
    if not len(buf):
        return out
    base = counts_of(buf, offs)
    words = np.maximum(base["n_words"], 1)
    starts, ends, row = word_spans(buf, offs)
    size = ends - starts

    def per_row(flags: np.ndarray) -> np.ndarray:
        acc = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=acc[1:])
        return acc[offs[1:]] - acc[offs[:-1]]

    def of_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=flags, minlength=n)

    letters = np.maximum(per_row(_LETTER[buf]), 1)
    h = span_hash(buf, starts, ends)
    adjacent, distinct, top = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(h):
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        adjacent = of_words(same)
        key = np.sort(row_hash(h, row))
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        owner = (key[at] >> np.uint64(64 - max(1, int(row.max()).bit_length()))).astype(np.int64)
        distinct = np.bincount(owner, minlength=n)
        np.maximum.at(top, owner, np.diff(np.append(at, len(key))))
    mean = of_words(size) / words
    spread = np.sqrt(np.maximum(of_words(size.astype(np.float64) ** 2) / words - mean**2, 0))
    cols = [
        np.log1p(base["n_words"]), base["word_chars"] / words, base["n_symbols"] / words, base["n_dup_lines"] / words, base["n_repeat_words"] / words,
        adjacent / words, distinct / words / np.log1p(words), (per_row(buf == 10) + 1) / words, per_row(_STOP[buf]) / words, per_row(_COMMA[buf]) / words,
        per_row(_BANG[buf]) / words, per_row(_UPPER[buf]) / letters, per_row(_DIGIT[buf]) / words, per_row(_WIDE[buf]) / letters, of_words(size <= 3) / words,
        of_words(size >= 12) / words, per_row(_CONTROL[buf]) / words, of_words(_UPPER[buf[starts]]) / words, spread, top / words,
    ]
    out[:] = np.stack(cols, axis=1)
    return out


@dataclass
class Model:
    """Bin edges, an intercept and lookup tables; plain arrays, so it travels with the tasks."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        margin = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            margin += t[b[:, i]]
        for i, j, t in self.pairs:
            margin += t[_coarse(b[:, i], self.edges[i]), _coarse(b[:, j], self.edges[j])]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _coarse(b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return b * PAIR_BINS // (len(edges) + 1)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(gain, place) of the best cut of a histogram; place 0 means none."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch, cn = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    tg, th, tn = g.sum(), h.sum(), n.sum()
    gain = cg**2 / (ch + RIDGE) + (tg - cg) ** 2 / (th - ch + RIDGE) - tg**2 / (th + RIDGE)
    gain[(cn < MIN_ROWS) | (tn - cn < MIN_ROWS)] = 0
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a shallow tree on one feature's histogram."""
    gain, k = _best_cut(g, h, n) if depth else (0.0, 0)
    if not k:
        return np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:k], h[:k], n[:k], depth - 1), _tree(g[k:], h[k:], n[k:], depth - 1)])


def _tree2(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by cell of a shallow tree on two features' histogram."""
    cuts = [_best_cut(*(a.sum(axis=1 - axis) for a in (g, h, n))) for axis in (0, 1)] if depth else [(0.0, 0), (0.0, 0)]
    axis = int(cuts[1][0] > cuts[0][0])
    k = cuts[axis][1]
    if not k:
        return np.full(g.shape, -g.sum() / (h.sum() + RIDGE))
    low, high = (tuple(np.split(a, [k], axis=axis)[s] for a in (g, h, n)) for s in (0, 1))
    return np.concatenate([_tree2(*low, depth - 1), _tree2(*high, depth - 1)], axis=axis)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn a model from features and 0/1 labels; without both labels the score is constant."""
    edges = []
    for i in range(x.shape[1]):
        e = np.unique(np.quantile(x[:, i], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0)
        edges.append(e.astype(np.float32))
    prior = float(np.clip((y.sum() + 1) / (len(y) + 2), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    model = Model(edges, float(np.log(prior / (1 - prior))), [np.zeros(len(e) + 1) for e in edges], [])
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for i, t in enumerate(model.tables):
            g, h = slopes()
            size = len(t)
            hist = [np.bincount(b[:, i], weights=w, minlength=size) for w in (g, h, None)]
            step = STEP * _tree(*hist)
            t += step
            margin += step[b[:, i]]
    coarse = [_coarse(b[:, i], e) for i, e in enumerate(edges)]
    g, h = slopes()

    def grid(i: int, j: int, w) -> np.ndarray:
        return np.bincount(coarse[i] * PAIR_BINS + coarse[j], weights=w, minlength=PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    gains = []
    for i in range(len(edges)):
        for j in range(i + 1, len(edges)):
            gg, hh = grid(i, j, g), grid(i, j, h)
            gains.append((float((gg**2 / (hh + 8 * RIDGE)).sum()), i, j))
    chosen = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in chosen:
            g, h = slopes()
            step = STEP * _tree2(grid(i, j, g), grid(i, j, h), grid(i, j, None))
            t += step
            margin += step[coarse[i], coarse[j]]
    model.pairs = chosen
    return model


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 1 when divided by 3; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows that are not held out, those of least hash.

    Labels other than 0 and 1 and null ids are left out; ids with several label rows count with each. The
    chosen labels are bounded by ``max_rows``, so they may be broadcast.
    """
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~is_held_out(F.col("doc_id")))
    chosen = usable.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__y")).orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_rows)
    rows = docs.select(F.col("doc_id").alias("__d"), "text").join(F.broadcast(chosen), F.col("__d") == F.col("__id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(2))
            for lo, hi in row_slices(offs):
                x = features_of(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), flat], names=["id", "y", "x"])

    got = rows.select(F.col("__id").cast("long"), "__y", F.col("text").cast("string")).mapInArrow(run, "id long, y int, x array<float>")
    found = got.orderBy(F.xxhash64("id"), "id", "y", "x").limit(max_rows).toArrow()
    x = np.array(found.column("x").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, found.column("y").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: quality 1 likelier) and predicted of each whole text.

    Only the text is scored; null counts as empty. Null ids are held out. Repeated rows and
    empty texts are scored like others; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(2))
            for lo, hi in row_slices(offs):
                s = model.score(features_of(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
                cols = [batch.column(i).slice(lo, hi - lo) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
