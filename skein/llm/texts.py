"""Whole texts as arrays of word hashes, without a Python object per word.

Arrow hands a batch of texts over as one buffer of UTF-8 bytes with offsets. Words are the maximal
runs of bytes other than ASCII white space (0x20, 0x09-0x0D); all other bytes, multi-byte
characters included, belong to words. A word is represented by a 64-bit hash of its bytes: two
different words meet with a probability near 2**-64, and every result below is exact up to that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POW, _UNPOW = _powers(_BASE, _SEGMENT), _powers(_UNBASE, _SEGMENT)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if large else np.int32
    offsets = np.frombuffer(off, width)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words' bytes, and for each document the index of its first word, with the total at the end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[0] = cut[n] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:n]
    closes = word
    closes[:-1] &= ~word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            at = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, at + _SEGMENT, "right")))
            part = data[at : ends[j - 1]]
            part = (_LOWER[part] if lower else part).astype(np.uint64)
            part += np.uint64(1)
            up, down = (_POW, _UNPOW) if len(part) <= _SEGMENT else (_powers(_BASE, len(part)), _powers(_UNBASE, 1))
            part *= up[: len(part)]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=total[1:])
            a, b = starts[i:j] - at, ends[i:j] - at
            out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            i = j
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, index of each document's first word with the total at the end)."""
    starts, ends, first = word_bounds(data, offsets)
    return word_hashes(data, starts, ends, lower), first


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries; entry i starts at i. Windows across documents are for the caller to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out *= np.uint64(0xC2B2AE3D27D4EB4F)
            out += h[j : j + n]
    return mix(out)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Marks the window starts whose k words lie in one document."""
    n = max(0, int(first[-1]) - k + 1)
    ok = np.ones(n, bool)
    for at in np.unique(first[1:-1]):
        ok[max(0, at - k + 1) : at] = False
    return ok


def pieces(n_docs: int, offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes; a larger document has a range of its own."""
    out, a = [], 0
    while a < n_docs:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        out.append((a, min(b, n_docs)))
        a = out[-1][1]
    return out


def blocks_for(total_bytes: int | None, each: int) -> int:
    """How many blocks of about `each` bytes hold the input: the number follows the input."""
    return max(1, -(-int(total_bytes or 0) // each))


#: The most partitions of a shuffle, as the driver keeps track of each; beyond that they hold several blocks and spill.
MOST_PARTITIONS = 20_000


def partitions_for(blocks: int, spark: SparkSession) -> int:
    """Shuffle partitions for so many blocks: one for each, within bounds."""
    return min(MOST_PARTITIONS, max(blocks, spark.sparkContext.defaultParallelism))
