"""SentencePiece encoding and decoding through a table of distinct chunks.

The model's pieces carry the whitespace marker only at their front, so no merge joins a
character to a marker that follows it. A text therefore falls into chunks, a run of markers and
what follows up to the next marker, that the model segments independently. Within a slice of texts the
distinct chunks are found by sorting hashes of the words, each new one is segmented once, many in one
call, and ids are gathered back to the texts by position. ``check_model`` proves the property for the model
at hand and refuses models that lack it.

Two words count as equal if a 64-bit hash, their length and their first and last eight bytes agree.
Texts with runs of spaces, spaces at an end or literal markers have chunks with spaces in front, kept in a table of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import row_slices, text_buffers
from noteloom.llm.textvec import mix64, span_hash

MARK = "▁"
#: Words kept between slices in each Python worker; a full table starts anew, results don't change.
TABLE_ROWS = 400_000
#: Bytes of text turned into ids at a time.
SLICE_BYTES = 3 << 20
#: Words segmented in one call.
WORDS_PER_CALL = 256


def load_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_model(path: str) -> None:
    """Raise ValueError unless chunks are independent: markers only in front, identity normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    if norm.precompiled_charsmap or not plain or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model's normaliser is not the identity with a leading marker")
    if any(p.type == 4 for p in proto.pieces):
        raise ValueError("user-defined pieces may cross chunks")
    if any(MARK in p.piece.lstrip(MARK) for p in proto.pieces):
        raise ValueError("a piece holds a marker after other characters")


def split_chunks(text: str) -> list[str]:
    """Chunks of a text, each written without its first marker, the others as spaces.

    The dummy prefix gives the first chunk its marker. A chunk '' is a lone marker.
    """
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, gap = [], 0
    for p in parts:
        if p:
            out.append(" " * gap + p)
            gap = 0
        else:
            gap += 1
    if gap:
        out.append(" " * (gap - 1))
    return out


def _edges_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of length, first and last eight bytes of each span."""
    wide = np.zeros(len(buf) + 16, np.uint8)
    wide[8:-8] = buf
    eight = np.lib.stride_tricks.sliding_window_view(wide, 8)
    size = ends - starts
    spare = (np.uint64(8) * (np.uint64(8) - np.minimum(size, 8).astype(np.uint64))).astype(np.uint64)
    first = np.ascontiguousarray(eight[starts + 8]).view("<u8")[:, 0] << spare
    last = np.ascontiguousarray(eight[ends]).view("<u8")[:, 0] >> spare
    return mix64(first ^ mix64(last ^ mix64(size.astype(np.uint64))))


class ChunkTable:
    """Segments slices of texts by their distinct words."""

    def __init__(self, path: str, limit: int = TABLE_ROWS):
        self.model, self.limit = load_model(path), limit
        n = self.model.get_piece_size()
        self.kind = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.width = self.kind.itemsize
        self.eos = self.model.eos_id()
        self.opens = np.array([self.model.id_to_piece(i).startswith(MARK) for i in range(n)])
        self.spaced: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.hash, self.edge = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _plain(self, text: str) -> np.ndarray:
        """Ids of texts that aren't words with single spaces between: each distinct chunk, its spaces included, is segmented once."""
        chunks = split_chunks(text)
        if len(self.spaced) > self.limit:
            self.spaced = {}
        fresh = [c for c in dict.fromkeys(chunks) if c not in self.spaced]
        if fresh:
            lone = self.model.piece_to_id(MARK)
            self.spaced.update((c, ids if c else [lone]) for c, ids in zip(fresh, self.model.encode(fresh, num_threads=1), strict=True))
        known = self.spaced
        return np.array([i for c in chunks for i in known[c]], self.kind)

    def _segment(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of distinct words, many in one call; a word's first id is its only one that opens with a marker."""
        size = ends - starts + 1
        at = np.cumsum(size) - size
        place = np.repeat(starts - at, size) + np.arange(int(size.sum()))
        spaced = buf[np.minimum(place, len(buf) - 1)]
        spaced[at + size - 1] = 32
        data, cuts = spaced.tobytes(), [*at[::WORDS_PER_CALL].tolist(), len(spaced)]
        texts = [data[x : y - 1].decode() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        got = self.model.encode(texts, num_threads=1)
        ids = np.concatenate([np.array(part, self.kind) for part in got])
        first = np.flatnonzero(self.opens[ids])
        if len(first) != len(starts):  # can't be with a model that check_model accepts
            raise ValueError("a word's ids don't begin with one marker")
        return ids, np.diff(np.append(first, len(ids)))

    def encode_slice(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the rows of a text buffer, exactly the library's ids."""
        n = len(offs) - 1
        if not len(buf):
            return np.zeros(0, self.kind), np.zeros(n + 1, np.int64)
        gap = buf == 32
        first = np.zeros(len(buf) + 1, bool)
        first[offs] = True
        odd = gap & (first[:-1] | first[1:])  # a space at the front or the end of a row
        odd[1:] |= gap[1:] & gap[:-1]
        mark = np.flatnonzero(buf == 0x81)
        mark = mark[mark >= 2]
        odd[mark[(buf[mark - 1] == 0x96) & (buf[mark - 2] == 0xE2)]] = True
        slow = np.zeros(n, bool)
        slow[np.searchsorted(offs, np.flatnonzero(odd), side="right") - 1] = True
        starts = ~gap
        ends = starts.copy()
        starts[1:] &= gap[:-1] | first[1:-1]
        ends[:-1] &= gap[1:] | first[1:-1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        row = np.searchsorted(offs, s, side="right") - 1
        if slow.any():
            use = ~slow[row]
            s, e, row = s[use], e[use], row[use]
        flat, size = self._words(buf, s, e)
        count = np.bincount(row, weights=size, minlength=n).astype(np.int64)
        if not slow.any():
            return flat, np.concatenate([[0], np.cumsum(count)])
        bounds = np.concatenate([[0], np.cumsum(count)])
        parts = [self._plain(buf[offs[i] : offs[i + 1]].tobytes().decode()) if slow[i] else flat[bounds[i] : bounds[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _words(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids of each word)."""
        if not len(s):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        h, edge = span_hash(buf, s, e), _edges_of(buf, s, e)
        distinct, at, back, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        if (edge != edge[at][back]).any():  # two words of one hash: told apart by the other digest
            h = mix64(h ^ edge)
            distinct, at, back, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        de = edge[at]
        spot = np.minimum(np.searchsorted(self.hash, distinct), max(len(self.hash) - 1, 0))
        known = np.zeros(len(distinct), bool)
        if len(self.hash):
            known = (self.hash[spot] == distinct) & (self.edge[spot] == de)
        new = np.flatnonzero(~known)
        ids, size = self._segment(buf, s[at[new]], e[at[new]]) if len(new) else (np.zeros(0, self.kind), np.zeros(0, np.int64))
        begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size
        pool = np.concatenate([self.ids, ids])
        w_begin, w_size = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        w_begin[known], w_size[known] = self.begin[spot[known]], self.size[spot[known]]
        w_begin[new], w_size[new] = begin + len(self.ids), size
        n_ids = w_size[back]
        out_at = np.cumsum(n_ids) - n_ids
        gather = np.repeat(w_begin[back] - out_at, n_ids) + np.arange(int(n_ids.sum()))
        flat = pool[gather]
        self._keep(distinct, de, w_begin, w_size, known, times, pool)
        return flat, n_ids

    def _keep(self, distinct, edge, begin, size, known, times, pool) -> None:
        """Remember the new words; a table that would grow too large starts anew with the frequent ones."""
        add = ~known
        if len(self.hash) + int(add.sum()) > self.limit:
            self._forget()
            add = times > 1
        if not add.any() or int(add.sum()) > self.limit:
            return
        b, z = begin[add], size[add]
        take = np.repeat(b - (np.cumsum(z) - z), z) + np.arange(int(z.sum()))
        starts = len(self.ids) + np.cumsum(z) - z
        h = np.concatenate([self.hash, distinct[add]])
        order = np.argsort(h, kind="stable")
        self.hash, self.edge = h[order], np.concatenate([self.edge, edge[add]])[order]
        self.begin, self.size = np.concatenate([self.begin, starts])[order], np.concatenate([self.size, z])[order]
        self.ids = np.concatenate([self.ids, pool[take]])

    def encode_column(self, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets) of slices of a text column; null counts as empty."""
        buf, offs = text_buffers(col)
        for lo, hi in row_slices(offs, SLICE_BYTES):
            ids, at = self.encode_slice(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            yield lo, hi, ids, at


def _output(ids: bool) -> str:
    return "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<int>, decoded string" if ids else ""
    )


def encode_decode(docs: DataFrame, model_path: str, with_outputs: bool = True) -> DataFrame:
    """Encode each whole text, decode the ids again.

    Input columns: doc_id, text; others are ignored. Null text counts as empty: no ids, an empty
    decoded text. A null doc_id stays null; repeated rows give repeated results. Returns doc_id,
    n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256, and with
    ``with_outputs`` also ids and decoded. Texts may be of any length; an empty table gives an empty result.
    """
    check_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sha = ChunkTable(model_path), hashlib.sha256
        for batch in batches:
            for lo, hi, flat, at in table.encode_column(batch.column(1)):
                id_sums, text_sums, texts = [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids = flat[a:b].tolist()
                    decoded = table.model.decode(ids) if ids else ""
                    id_sums.append(sha(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                    text_sums.append(sha(decoded.encode()).hexdigest())
                    if with_outputs:
                        texts.append(decoded)
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_outputs:
                    cols += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32))), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _output(with_outputs))
