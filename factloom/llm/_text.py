"""Vectorised text primitives: whole Arrow batches of texts as flat byte arrays.

A batch is processed in slices of bounded size, so a task's memory is bounded by
one slice or by one document, whichever is larger. Hash tables and powers are
rebuilt deterministically in each worker.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one slice holds (a longer document is a slice of its own).
SLICE_BYTES = 1 << 18

#: ASCII upper to lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words [^\x20\x09-\x0D]+
BLANK_WORD = np.ones(256, dtype=bool)
BLANK_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True

_ROOT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ROOT, -1, 1 << 64)
_BYTE = None
_POWERS: dict[int, np.ndarray] = {}


def tidy(run: Callable) -> Callable:
    """run, and what it leaves free goes back to the system: Python workers live on between tasks, and so would their largest size."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, len(have) * 2 if have is not None else 0)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences, scaled by `span_hash`, identify substrings."""
    global _BYTE
    if _BYTE is None:
        _BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * _powers(_ROOT, len(data)), out=out[1:])
    return out


def row_sums(rows: np.ndarray) -> np.ndarray:
    """Running sums along each row of a byte matrix: differences of equal columns compare spans."""
    prefix_hash(np.zeros(0, np.uint8))
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), dtype=U64)
    np.cumsum(_BYTE[rows] * _powers(_ROOT, rows.shape[1])[None, :], axis=1, out=out[:, 1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal spans anywhere."""
    low = (prefix[end] - prefix[start]) * _powers(_INVERSE, len(prefix))[start]
    return mix(low + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): the column's texts in order; null counts as empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.string())
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text): spans of words; no word crosses two texts.

    The third array has one entry per text and one at the end.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1]
    cut = cut[cut < len(data)]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = offsets[1:]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and each text's first word."""
    low = LOWER[data]
    start, end, first = words(low, offsets, table)
    return span_hash(prefix_hash(low), start, end), first


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words (also those that cross texts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for j in range(k):
        total += hashes[j : j + n] * mix(np.array([7919 * (j + 1) + k], U64))[0]
    return mix(total)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of one text; fewer words make one shingle."""
    if not len(hashes):
        return np.zeros(0, U64)
    if len(hashes) < k:
        return mix(grams(hashes, len(hashes)) + U64(len(hashes)))
    return np.unique(grams(hashes, k))
