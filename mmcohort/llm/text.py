"""Word hashing on Arrow buffers, shared by the text operators.

Words are hashed from the UTF-8 bytes with numpy: no Python object per word.
A word's hash is a polynomial over random 64-bit byte values, finalised by a
multiply-xor mixer; two different words agree with probability about 2**-64.
Texts of any length are worked through in slices cut between words, so memory
is bounded by the slice, the longest word and eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18  # bytes hashed at once

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


# the kinds of words, as plain strings: closures carry them to workers by value
ALNUM = "alnum"  # a word: a-z, 0-9 and everything beyond ASCII
SPACE = "space"  # a word: everything but space and 0x09-0x0D


def _table(kind: str) -> np.ndarray:
    """Bytes with A-Z lower-cased and separators as 0."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    if kind == SPACE:
        t[9:14] = t[32] = 0
    else:
        for lo, hi in ((0, 48), (58, 65), (91, 97), (123, 128)):
            t[lo:hi] = 0
    return t


_TABLES = {kind: _table(kind) for kind in (ALNUM, SPACE)}
_WORD = {kind: t != 0 for kind, t in _TABLES.items()}
_WORD[SPACE][0] = True  # NUL is no white space


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_POW = np.cumprod(np.full(256, _BASE, dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = np.cumprod(np.full(max(n, 2 * len(_POW)), _BASE, dtype=np.uint64))
    return _POW


def _hash_slice(low: np.ndarray, word: np.ndarray, starts: np.ndarray, prefixes: tuple[int, ...]) -> np.ndarray:
    """(1 + prefixes, words): hashes of the words and of their first bytes."""
    if not len(starts):
        return np.empty((1 + len(prefixes), 0), np.uint64)
    first = starts[0]
    ends = np.append(starts[1:], len(low))
    k = np.arange(first, len(low)) - np.repeat(starts, ends - starts)
    w = word[first:]
    most = int(k[w].max()) + 1
    vals = _BYTE[low[first:]] * _powers(most)[np.minimum(k, most - 1)]
    vals[~w] = 0
    out = [np.add.reduceat(vals, starts - first)]
    if prefixes:
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(vals)])
        for p in prefixes:  # a shorter word is its own prefix
            out.append(run[np.minimum(starts + p, ends) - first] - run[starts - first])
    return mix(np.stack(out))


def hash_words(buf: np.ndarray, kind: str = ALNUM, breaks: np.ndarray | None = None, prefixes: tuple[int, ...] = ()):
    """Hashes and byte places of the words of ``buf`` (uint8), in order;
    ``breaks``: byte places where a new text begins. With ``prefixes`` the
    hashes have a row more for the first so many bytes of each word."""
    hashes, places = [], []
    breaks = np.zeros(1, np.int64) if breaks is None else breaks
    lo, n = 0, len(buf)
    while lo < n:
        hi = min(n, lo + SLICE)
        step = 4096
        while hi < n:  # up to the next separator
            more = buf[hi : hi + step]
            sep = np.flatnonzero(~_WORD[kind][more])
            if len(sep):
                hi += int(sep[0])
                break
            hi, step = min(n, hi + step), step * 2
        raw = buf[lo:hi]
        low, word = _TABLES[kind][raw], _WORD[kind][raw]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        b = breaks[np.searchsorted(breaks, lo) : np.searchsorted(breaks, hi)] - lo
        begin[b] |= word[b]
        starts = np.flatnonzero(begin)
        hashes.append(_hash_slice(low, word, starts, prefixes))
        places.append(starts + lo)
        lo = hi
    h = np.concatenate(hashes, 1) if hashes else np.empty((1 + len(prefixes), 0), np.uint64)
    s = np.concatenate(places) if places else np.empty(0, np.int64)
    return (h if prefixes else h[0]), s


class Texts:
    """Some texts of an Arrow column as one byte buffer with word hashes.

    ``hash``: all word hashes (with ``prefixes``: a row each);
    ``at[i]:at[i+1]``: the words of text ``i``.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, kind: str, prefixes: tuple[int, ...] = ()):
        self.buf, self.offsets = buf, offsets
        self.hash, self.starts = hash_words(buf, kind, np.unique(offsets[:-1]), prefixes)
        self.at = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1


def _binary(col: pa.Array) -> pa.Array:
    col = col.cast(pa.large_binary())
    return col.fill_null(b"") if col.null_count else col


def text_groups(
    col, kind: str = ALNUM, limit: int = 1 << 20, prefixes: tuple[int, ...] = ()
) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, Texts) over a string column, nulls as empty, about
    ``limit`` bytes at a time (a longer text makes a group of its own)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
    col = _binary(col)
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, Texts(buf[off[i] : off[j]], off[i : j + 1] - off[i], kind, prefixes)
        i = j


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words (empty if fewer words)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(_gram_weights(k)):
        out += h[j : j + n] * c
    return mix(out)


def _gram_weights(k: int) -> np.ndarray:
    return np.cumprod(np.full(k, np.uint64(0xA24BAED4963EE407), dtype=np.uint64))
