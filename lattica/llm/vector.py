"""Vectorised text kernels shared by the corpus operators.

Every kernel works on the raw UTF-8 bytes of a block of rows, so no Python
object is made per word.  A *block* is ``(first_row, bytes, offsets)`` where
row ``first_row + i`` owns ``bytes[offsets[i]:offsets[i + 1]]``; a null text is
an empty row.  Hashes are 64 bit and depend on content alone, never on where
the content stands, so equal text hashes equally in every task and every rerun.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; working memory is about forty times as much.
BLOCK_BYTES = 1 << 17

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words (the public splitmix64 sequence)."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=_U) + _U(seed * 1000003)) * _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def splitmix(n: int, seed: int) -> np.ndarray:
    return _splitmix(n, seed)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

BYTE_CODE = _splitmix(256, 1)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[ord("A") : ord("Z") + 1] = BYTE_CODE[ord("a") : ord("z") + 1]


class _Powers:
    """Powers of the base and of its inverse, grown when a longer block comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, _BASE, dtype=_U))), dtype=_U)
                self.down = np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, _INVERSE, dtype=_U))), dtype=_U)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the hash of codes[i:j] times base**i."""
    up, _ = _POWERS.upto(len(codes) + 1)
    out = np.zeros(len(codes) + 1, dtype=_U)
    with np.errstate(over="ignore"):
        np.cumsum(codes * up[: len(codes)], dtype=_U, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), wherever they stand."""
    _, down = _POWERS.upto(len(prefix))
    with np.errstate(over="ignore"):
        h = (prefix[end] - prefix[start]) * down[start]
        return mix(h ^ ((end - start).astype(_U) * _U(0xD6E8FEB86659FD93)))


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()) if column.type != pa.large_binary() else column


def _trim():
    """The C library's call that gives freed pages back, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


_TRIM = _trim()


def release() -> None:
    """Give freed memory back, so that a worker between batches holds little more than its imports."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def blocks(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of whole rows with about ``limit`` bytes each; a longer row stands alone."""
    limit = limit or BLOCK_BYTES
    column = text_array(column).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    at = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + 20_000)
        yield lo, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
    if n > 1:
        release()


def words(raw: np.ndarray, offsets: np.ndarray, codes: np.ndarray = BYTE_CODE, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, first): spans and hashes of all words; row i owns words first[i]:first[i + 1]."""
    full = ~space[raw]
    if not full.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=_U), np.zeros(len(offsets), dtype=np.int64)
    opens, closes = full.copy(), full.copy()
    opens[1:] &= ~full[:-1]
    closes[:-1] &= ~full[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    opens[edge] = full[edge]
    closes[edge - 1] = full[edge - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, span_hash(prefix_sums(codes[raw]), start, end), np.searchsorted(start, offsets, side="left")


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, index): hashes of all runs of k words inside a row, and the word where each starts."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    m = n - k + 1
    with np.errstate(over="ignore"):
        g = np.zeros(m, dtype=_U)
        for j in range(k):
            g = g * _U(_BASE) + hashes[j : j + m]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = row[:m] == row[k - 1 :]
    at = np.flatnonzero(inside)
    return mix(g[at] + _U(k)), row[at], at


def whole_rows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the rows with 1 to k - 1 words: their whole word sequence as one shingle."""
    size = np.diff(first)
    row = np.flatnonzero((size > 0) & (size < k))
    out = np.zeros(len(row), dtype=_U)
    with np.errstate(over="ignore"):
        for j in range(k - 1):
            live = size[row] > j
            out[live] = out[live] * _U(_BASE) + hashes[first[row[live]] + j]
        return mix(out + size[row].astype(_U)), row


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int, codes: np.ndarray = LOWER_CODE) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds): sorted distinct k-word shingles of each row, shorter rows as one shingle."""
    _, _, h, first = words(raw, offsets, codes)
    g, row, _ = grams(h, first, k)
    s, short = whole_rows(h, first, k)
    g, row = np.concatenate((g, s)), np.concatenate((row, short))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    keep = np.ones(len(g), dtype=bool)
    keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[keep], row[keep]
    return g, np.searchsorted(row, np.arange(len(offsets)))


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours; length len(x) - w + 1."""
    out, span = x, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[: len(out) - (w - span)], out[w - span :])
    return out
