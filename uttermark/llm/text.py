"""Vectorised views of Arrow text columns: word spans, word hashes and n-gram hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, with A-Z
lower-cased on request. A word's hash is the sum of its eight-byte parts, each mixed with its place
by a bijection on 64 bits, mixed again with the word's length. A whole batch of documents is hashed
in a few passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_KEPT = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
_PART = np.uint64(0x9FB21C651E98DF25)
_place = [np.zeros(0, dtype=np.uint64)]

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    for i, base in enumerate((_BASE, _BASE_INV)):
        p = _powers[i]
        while len(p) < n:
            step = np.uint64(pow(base, len(p), 1 << 64))
            p = np.concatenate([p, p * step])
        _powers[i] = p
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _places(n: int) -> np.ndarray:
    """A random word for each place of a part in its span, at least ``n``."""
    if len(_place[0]) < n:
        with np.errstate(over="ignore"):
            _place[0] = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return _place[0]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word. ``off`` holds the rows' offsets into ``buf``."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SPACE[buf]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    inner = off[(off > 0) & (off < len(buf))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def span_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """Hash of each span ``buf[s:e]`` after mapping its bytes through ``table``."""
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(buf) + 8, np.uint8)
    np.take(table, buf, out=padded[: len(buf)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = e - s
    h = mix((eight[s] & _KEPT[np.minimum(size, 8)]) * _PART + _places(1)[0])
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3  # parts after the first
        first = np.cumsum(more) - more
        k = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        part = eight[np.repeat(s[long], more) + 8 * k] & _KEPT[np.minimum(np.repeat(size[long], more) - 8 * k, 8)]
        h[long] += np.add.reduceat(mix(part * _PART + _places(int(more.max()) + 1)[k]), first)
    return mix(h + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every run of ``n`` words inside one row."""
    m = len(h) - n + 1
    if m <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    g = h[:m].copy()
    for j in range(1, n):
        g = mix(g * np.uint64(0x9FB21C651E98DF25) + h[j : j + m])
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return g[at], row[at], at


def hashed_words(buf: np.ndarray, off: np.ndarray, table: np.ndarray = LOWER):
    """Hashes, rows, starts and ends of the words of the rows in ``buf``."""
    s, e, row = word_spans(buf, off)
    return span_hashes(buf, s, e, table), row, s, e


def bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Where each of rows 0..n-1 begins in a sorted array of row numbers, and the end."""
    return np.searchsorted(row, np.arange(n + 1))
