"""Vectorised text kernels shared by the corpus operators.

All of them work on the raw UTF-8 buffers of an Arrow string column, so a batch
of documents is tokenised and hashed without making one Python object per word.
Words are the maximal runs of bytes outside ``\\x20\\x09-\\x0D`` (UTF-8
continuation and lead bytes are never in that range, so this is the same as
taking ``[^\\x20\\x09-\\x0D]+`` over code points).

Temporary memory is bounded: hashing runs over pieces of ``PIECE`` bytes, and
:func:`slices` cuts Arrow batches so that one slice holds about ``PIECE`` bytes
of text or one document, whichever is more.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE = 1 << 20
#: Fixed odd multipliers of the polynomial and of the mixing steps (splitmix64 / murmur3 finalisers).
BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
GRAM = U64(0xD6E8FEB86659FD93)

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, in place on a fresh uint64 array."""
    h = h ^ (h >> U64(33))
    h *= MIX1
    h ^= h >> U64(33)
    h *= MIX2
    h ^= h >> U64(33)
    return h


#: Bytes with A-Z coded as a-z; masks of the first k bytes of a little-endian 8-byte lane.
_folded = np.arange(256, dtype=np.uint8)
_folded[65:91] += 32
_lane = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans may overlap and come in any order.

    Eight bytes at a time are keyed by their place and mixed before they are summed, so
    that no arithmetic between places makes structured spans equal, as it does for a
    polynomial modulo 2**64.
    """
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = _folded[data] if fold_case else data
    lanes = np.ndarray(len(data) + 1, "<u8", wide, strides=(1,))
    start, size = np.asarray(start, np.int64), (end - start).astype(np.int64)
    out = mix((lanes[start] & _lane[np.minimum(size, 8)]) ^ U64(BASE))
    out += size.astype(U64) * GRAM
    longer = np.flatnonzero(size > 8)
    count = (size[longer] - 1) // 8
    upto = np.cumsum(count)
    i = 0
    while i < len(longer):
        before = int(upto[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(upto, before + PIECE // 8, "right")))
        mine, many = longer[i:j], count[i:j]
        head = np.cumsum(many) - many
        place = np.arange(int(many.sum())) - np.repeat(head, many) + 1
        left = np.repeat(size[mine], many) - 8 * place
        value = lanes[np.repeat(start[mine], many) + 8 * place] & _lane[np.minimum(left, 8)]
        out[mine] += np.add.reduceat(mix(value ^ mix((place + 1).astype(U64) * U64(BASE))), head)
        i = j
    return mix(out)


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    up, down = np.full(n, BASE, U64), np.full(n, pow(BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = PIECE
    while size < n:
        size *= 2
    return powers(size)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row, one more than rows; nulls are empty."""
    col = pc.fill_null(col, "") if col.null_count else col
    wide = pa.types.is_large_string(col.type)
    at = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    found = col.buffers()[2]
    return np.frombuffer(found, np.uint8)[at[0] : at[-1]] if found is not None else np.zeros(0, np.uint8), at - at[0]


class Words:
    """The words of a slice of documents.

    data: bytes; doc_at: byte offset of each document, one more than documents;
    start, end: byte span of each word; first: index of each document's first word,
    one more than documents.
    """

    __slots__ = ("data", "doc_at", "end", "first", "start")

    def __init__(self, col: pa.Array):
        self.data, self.doc_at = raw(col)
        n = len(col)
        size = len(self.data)
        if not size:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(n + 1, np.int64)
            return
        space = _space[self.data]
        edge = np.empty(size, bool)
        edge[1:] = space[:-1]
        edge[self.doc_at[:-1][self.doc_at[:-1] < size]] = True
        self.start = np.flatnonzero(~space & edge)
        edge[:-1] = space[1:]
        edge[self.doc_at[1:][self.doc_at[1:] > 0] - 1] = True
        self.end = np.flatnonzero(~space & edge) + 1
        self.first = np.searchsorted(self.start, self.doc_at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Index of the document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, fold_case: bool = False) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end, fold_case)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive hashes; document edges are the caller's matter."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= GRAM
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def gram_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which an n-gram of one document starts, and how many each document has."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - first[:-1], counts), counts


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each document."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``most`` bytes of the column, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass, after which freed memory goes back to the system: workers are used again, and several stay idle beside those that work."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return held
