"""Vectorised words, hashes and shingles over UTF-8 buffers.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``. Hashes are 64-bit: a
polynomial prefix sum modulo 2**64 gives the hash of any span in two lookups; a finaliser mixes it.
"""

from __future__ import annotations

import numpy as np

_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_SEG = 1 << 20
_tables: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _tables_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables["pow"]) < n:
        size = max(n, _SEG + 4096)
        _tables.update(pow=_powers(_MUL, size), inv=_powers(_INV, size))
    return _tables["pow"], _tables["inv"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def is_space(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of all words; a word never crosses a row boundary."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~is_space(buf)
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:-1]
    ends = solid
    ends[:-1] &= is_space(buf[1:]) | first[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEG, side="right")))
            a, b = int(starts[i]), int(ends[j - 1])
            power, inverse = _tables_of(b - a + 1)
            acc = np.zeros(b - a + 1, np.uint64)
            np.cumsum((buf[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=acc[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = mix64((acc[e] - acc[s]) * inverse[s] + (e - s).astype(np.uint64))
            i = j
    return out


_LANE = [pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(16)]


def window_hash(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each k-word window inside one row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = words[:n] * np.uint64(_LANE[0])
        for j in range(1, k):
            h += words[j : j + n] * np.uint64(_LANE[j])
    ok = np.flatnonzero(row[:n] == row[k - 1 : k - 1 + n])
    return mix64(h[ok]), ok


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of k-word shingles, repeats included; a row of 1 to k-1 words has one: all of them."""
    h, at = window_hash(words, row, k)
    owner = row[at]
    counts = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        pick = np.flatnonzero(np.isin(row, short))
        lane = np.array(_LANE, np.uint64)[pick - first[row[pick]]]
        with np.errstate(over="ignore"):
            part = np.add.reduceat(words[pick] * lane, np.concatenate([[0], np.cumsum(counts[short])[:-1]]))
            part += counts[short].astype(np.uint64)
        h, owner = np.concatenate([h, mix64(part)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, owner


def row_hash(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One sortable key for (row, hash): the row in the top bits, the rest of the hash below.

    Rows of a slice stay under 2**14 or more bits of the hash are given up; at least 40 are kept.
    """
    bits = max(1, int(row.max()).bit_length()) if len(row) else 1
    return (row.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits))


def repeated(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each (row, hash): whether it occurs twice or more in its row."""
    key = row_hash(h, row)
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.empty(len(k), bool)
    out[order] = same
    return out


def sequence_hash(words: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's word sequence; rows without words get (0, 0)."""
    a, b = np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)
    if not len(words):
        return a, b
    counts = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    pos = np.arange(len(words)) - first[row]
    filled = np.flatnonzero(counts)
    with np.errstate(over="ignore"):
        p = pos.astype(np.uint64)
        for out, salt in ((a, 0x632BE59BD9B4E019), (b, 0xA0761D6478BD642F)):
            term = mix64(words ^ mix64((p + np.uint64(1)) * np.uint64(salt)))
            out[filled] = mix64(np.add.reduceat(term, first[filled]) + counts[filled].astype(np.uint64))
    return a, b
