"""Exact top-k search with BM25: sharded inverted indexes, block-max WAND pruning, an exact merge.

A shard holds some thousand whole documents, of one kind (as of one language) where a task has enough of it, in an order that puts
like ones together. Each term has a posting list in that order, cut at every ``BLOCK`` places, so blocks of different lists cover the same
documents; of each block the index knows the largest impact, of each list and each zone of blocks too. Some queries go over a shard at
once, each in these steps:

1. List bounds: if the most that the query's lists can give doesn't add up to the threshold, the shard is left out.
2. Short lists are one block and are read. If no zone can reach the threshold with what they give and the maxima of the others, the
   shard is left out.
3. The few frequent lists are kept as impacts by document, and their part is added for all these queries by a matrix product.
4. Block bounds: a block of the other lists is entered only if it has a document that can reach the threshold: what it has from
   steps 2 and 3 and the maxima of all other lists. This is the pivot test of WAND, made for all blocks at once; the
   others are skipped in all lists.
5. The postings of the blocks left are read. What a document has by then is its score up to rounding, so the k-th best of it raises the
   threshold, and only documents that reach that are scored, by their own postings.

No document at or above the threshold is passed over, so results are exact. The threshold starts from the k-th best score over the shards
searched before, a few, then a sixth, then all, which can only be too low. A task is a shard and a share of the queries.

Scores use statistics of the whole corpus (documents, mean length, document frequencies), so those of
shards compare, and the merge of each shard's best is the exact result. Queries are files of bounded size in the shared
folder, read one at a time.

Terms are 64-bit hashes of words: runs of ASCII letters and digits and of other characters beyond ASCII, in lower
case.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import new_dir, row_slices, staged, text_buffers
from noteloom.llm.textvec import span_hash

K1, B = 1.2, 0.75
#: Documents of a shard (65,536 at most, as places are 16-bit numbers), and postings from which it is closed before.
SHARD_DOCS, SHARD_POSTINGS, BLOCK = 16384, 4_000_000, 16
#: Kinds of documents that a task tells apart, and frequent words by which it does.
KINDS, MARKS = 4, 128
#: Share of a shard's documents from which a list is kept as impacts by document, and postings up to which a list is one block.
FREQUENT, SHORT = 0.07, 256
#: Queries whose frequent lists are added up in one matrix product.
TOGETHER = 256
#: Bounds are raised by so much against rounding.
SLACK = 1 + 1e-4
#: Blocks of a zone, postings of documents that are scored at once, and documents that are scored one by one.
ZONE, AT_ONCE, FEW = 32, 1 << 18, 16
#: Query terms in one file of queries, about 16 bytes each.
QUERY_TERMS = 250_000
#: Tasks for each core, where a wave has fewer shards than that; each then takes a share of the files of queries.
TASKS = 2
#: Shards that are searched first, for the first thresholds.
SEED_SHARDS = 2
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SHARD = "shard long, n_docs long, length long, kinds long, path string"
_ARRAYS = ["ids", "known", "dl", "vocab", "df", "docs", "tfs"]


def terms_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term hash, row) of all words of a text column, in order; null counts as empty."""
    buf, offs = text_buffers(pc.utf8_lower(col))
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = _WORDLIKE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:-1]
    ends[:-1] &= ~solid[1:] | first[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return span_hash(buf, s, e).view(np.int64), np.searchsorted(offs, s, side="right") - 1


def _counted(terms: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) with counts, by row and term."""
    order = np.lexsort((terms, row))
    t, r = terms[order], row[order]
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(first)
    return r[at], t[at], np.diff(np.append(at, len(t)))


class _Kinds:
    """Kinds of documents, told by their frequent words as languages are; learned from the first documents of a task.

    A kind only says which documents share a shard, so that few queries have to do with it; hits don't depend on it.
    """

    def __init__(self, row: np.ndarray, term: np.ndarray, n: int):
        vocab, df = np.unique(term, return_counts=True)
        self.marks = np.sort(vocab[np.argsort(-df, kind="stable")[:MARKS]])
        x = self._marked(row, term, n)
        # seeds: documents with the commonest word, then with the commonest one of those without it, and so on
        left, seeds = x.any(axis=1), []
        while left.any() and len(seeds) < KINDS:
            mine = left & (x[:, (x[left] > 0).sum(axis=0).argmax()] > 0)
            seeds.append(x[mine].mean(axis=0))
            left &= ~mine
        self.centres = np.array(seeds) if seeds else np.zeros((1, len(self.marks)))
        for _ in range(5):
            near = self._near(x)
            self.centres = np.array([x[near == c].mean(axis=0) if (near == c).any() else old for c, old in enumerate(self.centres)])

    def _marked(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        x = np.zeros((n, len(self.marks)))
        hit = np.flatnonzero(np.isin(term, self.marks))
        x[row[hit], np.searchsorted(self.marks, term[hit])] = 1
        return x / np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)

    def _near(self, x: np.ndarray) -> np.ndarray:
        size = np.sqrt((self.centres**2).sum(axis=1))
        return (x @ self.centres.T / np.maximum(size, 1e-9)).argmax(axis=1)

    def of(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """The kind of each of some documents, by their distinct (row, term)."""
        return self._near(self._marked(row, term, n))


class _Builder:
    """Documents of one shard, gathered slice by slice."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.row, self.term, self.tf, self.dl, self.kind = [], [], [], [], []
        self.n = self.postings = 0

    def add(self, ids: pa.Array, text: pa.Array) -> None:
        t, r = terms_of(text)
        self.put(ids, *_counted(t, r), np.bincount(r, minlength=len(ids)), np.zeros(len(ids), np.int8))

    def put(self, ids: pa.Array, row: np.ndarray, term: np.ndarray, tf: np.ndarray, dl: np.ndarray, kind: np.ndarray) -> None:
        self.ids.append(ids)
        self.row.append((row + self.n).astype(np.uint32))
        self.term.append(term)
        self.tf.append(tf.astype(np.uint32))
        self.dl.append(dl)
        self.kind.append(kind.astype(np.int8))
        self.n += len(ids)
        self.postings += len(term)

    def join(self, other: _Builder) -> None:
        """Take the documents of another builder too."""
        self.row += [r + np.uint32(self.n) for r in other.row]
        for name in ("ids", "term", "tf", "dl", "kind"):
            getattr(self, name).extend(getattr(other, name))
        self.n += other.n
        self.postings += other.postings

    def arrays(self) -> dict[str, np.ndarray]:
        """The shard's arrays: documents in place order, and postings by term, then by place."""
        n, dl = self.n, np.concatenate(self.dl)
        row, term, tf = (np.concatenate(x) for x in (self.row, self.term, self.tf))
        self.row = self.term = self.tf = []
        # like documents together: by kind, by the word that a document has most often, then by length
        top = np.zeros(n, np.int64)
        if len(term):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            most = np.maximum.reduceat(tf, first)
            at = np.flatnonzero(tf == np.repeat(most, np.diff(np.append(first, len(row)))))
            top[row[at]] = term[at]  # of several the greatest hash
        order = np.lexsort((dl, top, np.concatenate(self.kind)))
        place = np.empty(n, np.uint16)
        place[order] = np.arange(n)
        docs = place[row]
        del row, top
        by = np.argsort(docs, kind="stable")
        by = by[np.argsort(term[by], kind="stable")]
        term, docs, tf = term[by], docs[by], tf[by]
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        ids = pa.concat_arrays(self.ids)
        known = ids.is_valid().to_numpy(zero_copy_only=False)[order]
        df = np.diff(np.append(starts, len(term))).astype(np.uint32)
        return {"ids": ids.fill_null(0).to_numpy()[order], "known": known, "dl": dl[order].astype(np.uint32), "vocab": term[starts], "df": df, "docs": docs, "tfs": tf}


def save_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays in the shared folder."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    batch = pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.large_binary()) for a in arrays.values()], names=list(arrays))
    with store.open_output_stream(place) as out, pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
        file.write_batch(batch)


def load_arrays(path: str, names: list[str]) -> dict[str, pa.Buffer]:
    """The bytes of some of the arrays of a file."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_file(place) as source:
        options = pa.ipc.IpcReadOptions(included_fields=[_ARRAYS.index(n) for n in names])
        batch = pa.ipc.open_file(source, options=options).get_batch(0)
    return {n: batch.column(n)[0].as_buffer() for n in names}


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row for each shard of whole documents (doc_id, text), with the file of its arrays in the shared folder.

    Every row is indexed, rows without words and rows with null ids too. A shard's bytes never pass through the JVM; a
    task that is tried again writes files of new names, and only those in the rows count.
    """
    folder = new_dir(docs.sparkSession, "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, k = TaskContext.get().partitionId() << 24, itertools.count()

        def saved(made: _Builder) -> pa.RecordBatch:
            number = first + next(k)
            path = f"{folder}/{number}-{uuid.uuid4().hex}.arrow"
            kinds = len(np.unique(np.concatenate(made.kind)))
            arrays = made.arrays()
            save_arrays(path, arrays)
            values = [number, made.n, int(arrays["dl"].sum()), kinds, path]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["shard", "n_docs", "length", "kinds", "path"])

        def full(made: _Builder, n: int, postings: int) -> bool:
            return made.n + n > shard_docs or made.postings + postings > SHARD_POSTINGS

        kinds, step, made = None, min(1024, shard_docs), {}
        for batch in batches:
            _, offs = text_buffers(batch.column(1))
            for lo, hi in row_slices(offs):
                for at in range(lo, hi, step):
                    n = min(step, hi - at)
                    t, r = terms_of(batch.column(1).slice(at, n))
                    row, term, tf = _counted(t, r)
                    dl, ids = np.bincount(r, minlength=n), batch.column(0).slice(at, n)
                    kinds = kinds or _Kinds(row, term, n)
                    kind = kinds.of(row, term, n)
                    for c in np.unique(kind).tolist():
                        mine = kind == c
                        some = mine[row]
                        if c in made and full(made[c], int(mine.sum()), int(some.sum())):
                            yield saved(made.pop(c))
                        part = (np.cumsum(mine) - 1)[row[some]], term[some], tf[some], dl[mine], kind[mine]
                        made.setdefault(c, _Builder()).put(ids.filter(pa.array(mine)), *part)
                    # what is open is bounded for all kinds together
                    while len(made) > 1 and sum(b.postings for b in made.values()) > 1.5 * SHARD_POSTINGS:
                        yield saved(made.pop(max(made, key=lambda c: made[c].postings)))
        # what is left of the kinds shares shards
        rest = sorted(made.values(), key=lambda b: -b.postings)
        while rest:
            shard, others = rest[0], []
            for b in rest[1:]:
                if full(shard, b.n, b.postings):
                    others.append(b)
                else:
                    shard.join(b)
            yield saved(shard)
            rest = others

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SHARD)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of whole query texts (query_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = text_buffers(batch.column(1))
            for lo, hi in row_slices(offs):
                t, r = terms_of(batch.column(1).slice(lo, hi - lo))
                row, term, n = _counted(t, r)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), pa.array(term), pa.array(n, pa.int64())], names=["query_id", "term", "qtf"])

    return queries.select(F.col("query_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "query_id long, term long, qtf long")


def _frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                got = load_arrays(path, ["vocab", "df"])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(got["vocab"], np.int64)), pa.array(np.frombuffer(got["df"], np.uint32).astype(np.int64))], names=["term", "df"])

    return index.select("path").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``first``, one range after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _numbered(chosen: np.ndarray, n: int) -> np.ndarray:
    """For each of n lists its number among the chosen ones, or -1."""
    out = np.full(n, -1, np.int32)
    out[chosen] = np.arange(len(chosen))
    return out


class Shard:
    """One shard ready for queries.

    ``read`` and ``held`` count postings read before scoring, and those of the queries' lists, frequent ones left out.
    """

    def __init__(self, row: dict, mean: float):
        get = lambda k, kind: np.frombuffer(row[k], kind)
        self.ids, self.known, dl, self.vocab = get("ids", np.int64), get("known", bool), get("dl", np.uint32), get("vocab", np.int64)
        df, doc, tf = get("df", np.uint32).astype(np.int64), get("docs", np.uint16), get("tfs", np.uint32)
        self.n, self.read, self.held = len(self.ids), 0, 0
        self.blocks = -(-self.n // BLOCK)
        self.width = self.blocks * BLOCK
        self.norm = K1 * (1 - B + B * dl / mean)
        if not len(df):
            return
        # postings of the lists: the document above the impact's bits; impacts of half the width are enough for bounds, scores are made from counts
        self.pairs = np.empty(len(tf), np.int64)
        impact = self.pairs.view(np.float32)[::2]
        for lo in range(0, len(tf), 1 << 19):
            at = slice(lo, lo + (1 << 19))
            self.pairs[at] = doc[at].astype(np.int64) << 32
            impact[at] = self._impacts(tf[at], doc[at])
        self.parts = np.concatenate([[0], np.cumsum(np.bincount(self._upper(self.vocab), minlength=1 << len(df).bit_length()))])
        self.start = np.concatenate([[0], np.cumsum(df)])
        self.most = np.maximum.reduceat(impact, self.start[:-1])
        # frequent lists: impacts by document
        often = np.flatnonzero(df >= max(1, FREQUENT * self.n))
        self.often = _numbered(often, len(df))
        place, r = _spread(self.start[often], df[often]), np.repeat(np.arange(len(often)), df[often])
        self.rows = np.zeros((len(often), self.width), np.float32)
        self.rows[r, doc[place]] = impact[place]
        # others above SHORT postings: where their blocks begin, and the largest impact of each
        middle = np.flatnonzero((df > SHORT) & (self.often < 0))
        self.middle = _numbered(middle, len(df))
        self.places = np.empty((len(middle), self.blocks + 1), np.int32)
        self.maxima = np.zeros((len(middle), self.blocks), np.float32)
        for lo in range(0, len(middle), 256):
            part = middle[lo : lo + 256]
            place, r = _spread(self.start[part], df[part]), np.repeat(np.arange(len(part)), df[part])
            cell = r * self.blocks + doc[place] // BLOCK
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            self.maxima[lo + r[first], cell[first] % self.blocks] = np.maximum.reduceat(impact[place], first)
            size = np.zeros((len(part), self.blocks + 1), np.int32)
            size[r[first], cell[first] % self.blocks + 1] = np.diff(np.append(first, len(cell)))
            self.places[lo : lo + 256] = np.cumsum(size, axis=1) + self.start[part][:, None]
        zones = np.arange(0, self.blocks, ZONE)
        self.zone_rows = np.maximum.reduceat(self.rows, zones * BLOCK, axis=1)
        self.zone_maxima = np.maximum.reduceat(self.maxima, zones, axis=1)
        self.zones = zones
        # the postings of each document, in the order of the lists
        by = np.argsort(doc, kind="stable")
        self.words = np.repeat(np.arange(len(df), dtype=np.int32), df)[by]
        self.tf = tf[by]
        del by
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=self.n))])
        self._weight = np.zeros(len(df))

    def _impacts(self, tf: np.ndarray, doc: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.float64)
        return tf * (K1 + 1) / (tf + self.norm[doc])

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term's list, -1 where there is none."""
        out = np.full(len(terms), -1, np.int64)
        if not len(self.vocab):
            return out
        # terms are hashes, so those of one upper part are few: they are tried one after the other
        part = self._upper(terms)
        at, end = self.parts[part], self.parts[part + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            spot = at[left]
            same = self.vocab[spot] == terms[left]
            out[left[same]] = spot[same]
            at[left] += 1
            left = left[~same & (spot + 1 < end[left])]
        return out

    def _upper(self, terms: np.ndarray) -> np.ndarray:
        bits = len(self.vocab).bit_length()
        return (terms >> (64 - bits)) + (1 << (bits - 1))

    def top(self, lists: np.ndarray, weights: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """``tops`` of one query."""
        return self.tops([(lists, weights)], k, [floor])[0]

    def tops(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, floors: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For some queries (lists in order, weights) at once: (places, scores) of documents that may be among the k best with
        a score of at least its floor."""
        out = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        frequent, heavy = np.zeros((len(queries), len(self.rows)), np.float32), np.zeros((len(queries), len(self.maxima)), np.float32)
        todo, brief = [], []
        for q, (lists, weights) in enumerate(queries):
            limit = max(floors[q], 1e-9) / SLACK
            if not len(lists) or weights @ self.most[lists] < limit:
                continue
            i, row, mid = len(todo), self.often[lists], self.middle[lists]
            first, size = self.start[lists], self.start[lists + 1] - self.start[lists]
            frequent[i], heavy[i] = 0, 0
            frequent[i, row[row >= 0]] = weights[row >= 0]
            heavy[i, mid[mid >= 0]] = weights[mid >= 0]
            at = np.flatnonzero((row < 0) & (mid < 0))
            self.held += int(size[row < 0].sum())
            part = self._sums(first[at], size[at], weights[at])
            # no document of any zone can reach the threshold: nothing else is made for this query
            if (frequent[i] @ self.zone_rows + heavy[i] @ self.zone_maxima + np.maximum.reduceat(part, self.zones * BLOCK)).max() >= limit:
                todo.append(q)
                brief.append(part)
        if todo:
            given, more = frequent[: len(todo)] @ self.rows, heavy[: len(todo)] @ self.maxima
            for i, q in enumerate(todo):
                brief[i] += given[i]
                out[q] = self._best_of(*queries[q], brief[i], more[i], k, floors[q])
        return out

    def _best_of(self, lists: np.ndarray, weights: np.ndarray, part: np.ndarray, more: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The documents of one query, from what short and frequent lists give each (``part``) and others at most give each block (``more``)."""
        limit, found = max(floor, 1e-9), (np.zeros(0, np.int64), np.zeros(0))
        if floor <= 0:
            limit = max(limit, self._least(part, k))
        live = (part.reshape(-1, BLOCK) >= (limit / SLACK - more)[:, None]).any(axis=1)
        if live.any():
            middle = self.middle[lists]
            at = np.flatnonzero(middle >= 0)
            part += self._sums(*self._within(live, middle[at], weights[at]))
            docs = np.flatnonzero(part >= limit / SLACK)
            limit = max(limit, self._least(part[docs], k))
            docs = docs[part[docs] >= limit / SLACK]
            ends, lo = np.cumsum(self.begin[docs + 1] - self.begin[docs]), 0
            while lo < len(docs):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, side="right")))
                found, limit = self._score(lists, weights, docs[lo:hi], found, k, limit)
                lo = hi
        keep = found[1] >= limit
        return found[0][keep], found[1][keep]

    @staticmethod
    def _least(part: np.ndarray, k: int) -> float:
        """What the k-th best score is at least, by what is known of each document; 0 if there are fewer."""
        return float(np.partition(part, len(part) - k)[len(part) - k]) / SLACK if len(part) >= k else 0.0

    def _sums(self, first: np.ndarray, size: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the postings of some ranges (first place, size, weight) give each document, up to rounding."""
        place = _spread(first, size)
        if not len(place):
            return np.zeros(self.width)
        self.read += len(place)
        found = np.take(self.pairs, place, mode="clip")
        value = np.repeat(weights, size)
        value *= found.view(np.float32)[::2]
        found >>= 32
        return np.bincount(found, weights=value, minlength=self.width)

    def _within(self, blocks: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ranges of some lists that neither are short nor frequent, in the marked blocks; blocks side by side are one range."""
        edges = np.diff(np.concatenate([[0], blocks.view(np.int8), [0]]))
        begin, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        first = self.places[np.ix_(rows, begin)]
        return first.ravel(), (self.places[np.ix_(rows, stop)] - first).ravel(), np.repeat(weights, len(begin))

    def _score(self, lists: np.ndarray, weights: np.ndarray, docs: np.ndarray, found: tuple[np.ndarray, np.ndarray], k: int, limit: float):
        """``found`` with some documents, scored by their own postings, and the threshold after them."""
        score = np.round(self._scores(lists, weights, docs), 9)
        keep = score >= limit
        docs, score = np.concatenate([found[0], docs[keep]]), np.concatenate([found[1], score[keep]])
        if len(score) >= k:
            limit = max(limit, float(np.partition(score, len(score) - k)[len(score) - k]))
        return (docs, score), limit

    def _scores(self, lists: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of some documents. A document's terms are added one by one in the order of their hashes, so equal texts have equal scores in any shard."""
        if len(docs) <= FEW:
            out, lists = np.zeros(len(docs)), lists.astype(np.int32)
            for i, doc in enumerate(docs):
                words = self.words[self.begin[doc] : self.begin[doc + 1]]
                if not len(words):
                    continue
                at = np.searchsorted(words, lists)
                at[at == len(words)] = 0
                hit = np.flatnonzero(words[at] == lists)
                if len(hit):
                    out[i] = np.cumsum(self._impacts(self.tf[self.begin[doc] + at[hit]], doc) * weights[hit])[-1]
            return out
        size = self.begin[docs + 1] - self.begin[docs]
        place = _spread(self.begin[docs], size)
        self._weight[lists] = weights
        weight = self._weight[self.words[place]]
        self._weight[lists] = 0
        hit = np.flatnonzero(weight)
        place, at = place[hit], np.repeat(np.arange(len(docs)), size)[hit]
        return np.bincount(at, weights=self._impacts(self.tf[place], docs[at]) * weight[hit], minlength=len(docs))

    def best(self, found: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
        """Which k of the found come first: by score, then by id, rows without one last."""
        docs, value = found
        return np.lexsort((self.ids[docs], ~self.known[docs], -value))[:k]


def _run(index: DataFrame, queries: str, files: int, mean: float, k: int) -> DataFrame:
    """(query_id, doc_id, score): each shard's candidates for the queries in the folder ``queries``, written as ``files`` files.

    A task is a shard and a share of the files, so a wave of few shards has work for all cores too.
    """
    shards = index.count()
    shares = max(1, min(files, -(-TASKS * index.sparkSession.sparkContext.defaultParallelism // max(1, shards))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(queries)
        names = sorted(f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.path.endswith(".parquet"))
        for batch in batches:
            for saved, share in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(load_arrays(saved, _ARRAYS), mean)
                for path in names[share::shares]:
                    with store.open_input_file(path) as source:
                        asked = pq.ParquetFile(source).read(["query_id", "xs", "floor"]).combine_chunks()
                    if asked.num_rows:
                        yield from _answers(shard, asked, k)

    tasks = index.select("shard", "path", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    # a task for each row, as the rows themselves are tiny
    tasks = tasks.repartitionByRange(max(1, shards * shares), "shard", "share").select("path", "share")
    return tasks.mapInArrow(run, "query_id long, doc_id long, score double")


def _answers(shard: Shard, asked: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """The candidates of one shard for one file of queries (query_id, xs, floor)."""
    xs = asked.column("xs").combine_chunks()
    cuts, flat = xs.offsets.to_numpy(), xs.values
    terms, weights = (flat.field(f).to_numpy() for f in ("term", "w"))
    lists = shard.find(terms)
    here = np.flatnonzero(lists >= 0)
    lists, weights = lists[here], weights[here]
    cuts = np.searchsorted(here, cuts)
    floors, ids = asked.column("floor").to_numpy(), asked.column("query_id").to_numpy()
    q_out, d_out, s_out = [], [], []
    some = np.flatnonzero(np.diff(cuts))
    for at in range(0, len(some), TOGETHER):
        part = some[at : at + TOGETHER]
        found = shard.tops([(lists[cuts[q] : cuts[q + 1]], weights[cuts[q] : cuts[q + 1]]) for q in part], k, floors[part].tolist())
        for q, (docs, score) in zip(part, found, strict=True):
            if len(docs):
                best = shard.best((docs, score), k)
                q_out.append(np.full(len(best), ids[q]))
                d_out.append(docs[best])
                s_out.append(score[best])
    if q_out:
        docs = np.concatenate(d_out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(q_out)), pa.array(shard.ids[docs], mask=~shard.known[docs]), pa.array(np.concatenate(s_out))], names=["query_id", "doc_id", "score"]
        )


def _best(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _filed(queries: DataFrame, label: str, blocks: int) -> str:
    """Write queries (query_id, xs, floor) into ``blocks`` files or more of the shared folder; the folder's path."""
    path = new_dir(queries.sparkSession, label)
    queries.repartition(blocks, "query_id").write.option("compression", "zstd").parquet(path)
    return path


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best rows of ``docs`` (doc_id, text) for each query (query_id, text).

    BM25 over whole texts, a query word counted as often as the query has it, scores rounded to 9 places, ties by
    doc_id (null last). Only rows that share a word with the query are hits, so there may be fewer than k. Null and
    empty texts match nothing; queries with a null id are left out, rows of one query id are one query. Texts may be of
    any length, repeated rows are hits of their own, empty tables give an empty result, and other columns, of any
    name, are ignored.
    """
    spark = docs.sparkSession
    index = staged(build_index(docs, shard_docs), "index")
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("length").alias("length"), F.count("*").alias("shards")).first()
    if not total.n or not total.length:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    n, mean = int(total.n), total.length / total.n
    # written, so that joins know their sizes: what a checkpoint is taken to hold is a guess, by which too much could be broadcast
    asked = staged(query_terms(queries.where("query_id IS NOT NULL")).groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf")), "query-terms")
    df = staged(_frequencies(index.repartitionByRange(int(total.shards), "shard")).join(asked.select("term").distinct(), "term", "left_semi"), "frequencies")
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").select("query_id", F.struct("term", (idf * F.col("qtf")).alias("w")).alias("x"))
    packed = staged(weighed.groupBy("query_id").agg(F.sort_array(F.collect_list("x")).alias("xs")), "queries")
    blocks = max(1, -(-(packed.agg(F.sum(F.size("xs"))).first()[0] or 0) // QUERY_TERMS))
    # each wave of shards starts from the k-th best scores over those before
    few = F.col("shard").isin([r.shard for r in index.orderBy(F.desc("kinds"), F.desc("n_docs"), "shard").select("shard").limit(SEED_SHARDS).collect()])
    sixth = F.pmod(F.xxhash64("shard"), F.lit(6)) == 0
    waves = [few, ~few] if total.shards <= 12 * SEED_SHARDS else [few, ~few & sixth, ~few & ~sixth]
    hits, asked = None, packed.withColumn("floor", F.lit(0.0))
    for wave in waves:
        found = _run(index.where(wave), _filed(asked, "asked", blocks), blocks, mean, k)
        hits = staged(_best(found if hits is None else found.union(hits.select("query_id", "doc_id", "score")), k), "hits")
        floors = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        asked = packed.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    return hits
