"""Words and hashes of many texts at once, with numpy over Arrow's own buffers.

A Block holds the bytes of some whole documents end to end. Blocks are cut at about `limit` bytes,
so that memory in a task is bounded by the longest document, not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
LIMIT = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters, and all of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words that end at ASCII white space only.
INK = np.ones(256, bool)
INK[32] = INK[9:14] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (Stafford's thirteenth variant)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BACK):
        p = np.ones(1, U64)
        for k in range(bits):
            p = np.concatenate([p, p * U64(pow(base, 1 << k, 1 << 64))])
        out.append(p)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 at least of an odd base modulo 2**64, and of its inverse."""
    return _powers(max(LIMIT.bit_length(), int(n).bit_length()))


class Block:
    """Rows lo..hi of a batch: lower-cased bytes, and where each document begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        self.raw = data
        self.bytes = LOWER[data]
        self.offsets = offsets

    def words(self, kind: np.ndarray) -> None:
        """Sets start, end and doc of every word made of bytes of this kind, and first: each document's first word."""
        on = kind[self.bytes]
        at = np.zeros(len(on) + 1, bool)
        at[:-1] = on
        before = np.zeros(len(on) + 1, bool)
        before[1:] = on
        before[self.offsets] = False
        self.start = np.flatnonzero(at & ~before)
        after = at.copy()
        after[self.offsets] = False
        stop = np.zeros(len(on), bool)
        stop[:] = on & ~after[1:]
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, by prefix sums of a polynomial modulo 2**64."""
        up, down = powers(len(self.bytes) + 1)
        total = np.zeros(len(self.bytes) + 1, U64)
        np.cumsum(_BYTE[self.bytes] * up[: len(self.bytes)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries; one for each place where k entries follow."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(0x9FB21C651E98DF25)
        out += h[j : j + n]
    return mix(out)


def binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if off is not None and len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, limit: int = LIMIT) -> Iterator[Block]:
    """Blocks of consecutive documents, of about limit bytes each."""
    data, offsets = binary(column)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(offsets) - 1)
        yield Block(data[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64), lo, hi)
        lo = hi
