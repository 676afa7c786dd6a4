"""Vectorised token kernels that work on the buffers of an Arrow string column.

A token is a maximal run of bytes other than space, tab, line feed, form feed
and carriage return, in the lower-cased text.  Tokens get 64-bit hashes from a
polynomial over their bytes, all tokens of a batch at once, so no Python object
is made for a token.  Nulls and empty texts simply have no tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 12, 13]] = False
#: Letters, digits and all that isn't ASCII: tokens without punctuation.
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
#: Texts are hashed in slices of about this many bytes, whatever the batch holds.
SLICE_BYTES = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) <= n:
        p = np.full(max(n + 1, SLICE_BYTES + 1), _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def raw_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(col: pa.Array):
    """Cut a column into runs of rows of about SLICE_BYTES; yields (first row, rows)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(col):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + SLICE_BYTES, side="right")))
        yield at, col.slice(at, end - at)
        at = end


def word_spans(raw: np.ndarray, off: np.ndarray, of: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte positions) and row of every token; of says which bytes belong to tokens."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = of[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = off[:-1][off[:-1] < len(raw)]
    start[first] = word[first]
    last = word.copy()
    last[:-1] &= ~word[1:]
    tail = off[1:][off[1:] > 0] - 1
    last[tail] = word[tail]
    s = np.flatnonzero(start)
    n = np.diff(np.searchsorted(s, off))
    return s, np.flatnonzero(last) + 1, np.repeat(np.arange(len(off) - 1), n)


def token_hashes(col: pa.Array, of: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, row of every token), in order of the lower-cased text."""
    raw, off = raw_buffers(pc.utf8_lower(col))
    s, e, row = word_spans(raw, off, of)
    if not len(s):
        return np.zeros(0, np.uint64), row
    p = _powers(len(raw))
    h = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=h[1:])
    return mix64((h[e] - h[s]) * p[len(raw) - s] * p_inverse(len(raw)) + (e - s).astype(np.uint64)), row


_INVERSE: dict[int, np.uint64] = {}


def p_inverse(n: int) -> np.uint64:
    """The number that undoes base ** n modulo 2 ** 64, so that hashes don't depend on the slice's length."""
    if n not in _INVERSE:
        if len(_INVERSE) > 4096:
            _INVERSE.clear()
        _INVERSE[n] = np.uint64(pow(int(_BASE), -n, 1 << 64))
    return _INVERSE[n]


def token_counts(col: pa.Array) -> np.ndarray:
    """Tokens of every row."""
    raw, off = raw_buffers(col)
    if not len(raw):
        return np.zeros(len(off) - 1, np.int64)
    word = _WORD[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = off[:-1][off[:-1] < len(raw)]
    start[first] = word[first]
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(start, out=total[1:])
    return np.diff(total[off])


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """Distinct values by sorting; for 64-bit integers far faster than hashing."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def gram_hashes(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of all word n-grams and their rows, in order of the text.

    A text of fewer than n tokens, but at least one, has one gram: all its tokens.
    """
    h, row = token_hashes(col)
    if not len(h):
        return h, row
    mult = np.uint64(0xD6E8FEB86659FD93)
    m = max(0, len(h) - n + 1)
    g = h[:m].copy()
    for k in range(1, n):
        g = g * mult + h[k : k + m]
    same = row[:m] == row[n - 1 :]
    g, r = g[same], row[:m][same]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    tokens = np.diff(np.r_[first, len(h)])
    for k in range(1, n):
        at = first[tokens == k]
        if len(at):
            x = h[at].copy()
            for j in range(1, k):
                x = x * mult + h[at + j]
            g, r = np.r_[g, x], np.r_[r, row[at]]
    return mix64(g) >> np.uint64(16), r


def gram_sets(col: pa.Array, n: int, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every row and their rows, sorted by row, class and hash.

    classes maps the upper bits of a hash, as many as its length needs, to its class (0 to 63); without it all are of one class.
    """
    g, r = gram_hashes(col, n)
    out_g, out_r = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if not len(g):
        return out_g[0], out_r[0]
    if len(r) > 1 and (r[1:] < r[:-1]).any():
        order = np.argsort(r, kind="stable")
        g, r = g[order], r[order]
    key = g if classes is None else g | (classes[(g >> np.uint64(49 - len(classes).bit_length())).astype(np.int64)].astype(np.uint64) << np.uint64(48))
    for at in range(int(r[0]), int(r[-1]) + 1, 1024):  # the row takes the upper 10 bits of the sort key
        a, b = np.searchsorted(r, [at, at + 1024])
        if a < b:
            k = sorted_unique(key[a:b] | ((r[a:b] - at).astype(np.uint64) << np.uint64(54)))
            out_g.append(k & np.uint64((1 << 48) - 1))
            out_r.append((k >> np.uint64(54)).astype(np.int64) + at)
    return np.concatenate(out_g), np.concatenate(out_r)
