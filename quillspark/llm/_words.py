"""Vectorised word kernels over Arrow string columns.

A word is a maximal run of bytes other than space and \\x09-\\x0D; those bytes never
occur inside a longer UTF-8 sequence, so words can be found and hashed on bytes. All
functions work on blocks of a few MB cut at document boundaries, so the scratch arrays
stay small whatever the size of a Spark batch; a single longer document is one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW_BASE = 0xC2B2AE3D27D4EB4F | 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n at least."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, _SEGMENT + 1)
        up = np.full(size, base, np.uint64)
        up[0] = 1
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        got = _powers[base] = (np.cumprod(up), np.cumprod(down))
    return got


@dataclass
class Words:
    """Words of a block: byte ranges, 64-bit hashes, and first[d]:first[d + 1] the
    words of document d of the block."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of blocks of a string or binary column; a
    null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the first word of each document."""
    n_docs = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(n_docs + 1, np.int64)
    body = ~SPACE[data]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    opens = body.copy()
    opens[1:] &= ~body[:-1]
    opens[inner] = body[inner]
    closes = body.copy()
    closes[:-1] &= ~body[1:]
    cut = inner[inner > 0] - 1
    closes[cut] = body[cut]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of ascending, disjoint byte ranges; lower folds A-Z first."""
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        s = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, s + _SEGMENT, "right")))
        e = int(ends[b - 1])
        part = data[s:e]
        if lower:
            part = part + ((part >= 65) & (part <= 90)).astype(np.uint8) * np.uint8(32)
        up, down = powers(_BASE, e - s + 1)
        total = np.zeros(e - s + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: e - s], out=total[1:])
        i, j = starts[a:b] - s, ends[a:b] - s
        h = (total[j] - total[i]) * down[i]
        out[a:b] = mix(h ^ ((j - i).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        a = b
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    starts, ends, first = find_words(data, offsets)
    return Words(data, offsets, starts, ends, first, hash_ranges(data, starts, ends, lower))


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every run of k words inside one document."""
    n = len(words.hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(words.first[1:], words.counts)
    at = np.flatnonzero(np.arange(n) + k <= last)
    if k <= 8:
        total = np.zeros(len(at), np.uint64)
        scale = 1
        for i in range(k):
            scale = scale * _WINDOW_BASE % (1 << 64)
            total += words.hashes[at + i] * np.uint64(scale)
        return at, mix(total)
    up, down = powers(_WINDOW_BASE, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hashes * up[:n], out=total[1:])
    return at, mix((total[at + k] - total[at]) * down[at])


def shingle_sets(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of every document of the block, and the
    offsets by document. A document of 1 to k - 1 words has its whole sequence as its
    one shingle, one without words an empty set."""
    n_docs = len(words.first) - 1
    at, h = windows(words, k)
    doc = words.doc[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for x, d in enumerate(short):
            t = np.full(1, words.counts[d], np.uint64)
            for w in range(words.first[d], words.first[d + 1]):
                t = mix(t * np.uint64(_WINDOW_BASE) + words.hashes[w : w + 1])
            whole[x] = t[0]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[keep], h[keep]
    return h, np.searchsorted(doc, np.arange(n_docs + 1), "left")


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags over each document's bytes or words."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def hits(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of wanted occur in sorted_values."""
    if not len(sorted_values):
        return np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted
