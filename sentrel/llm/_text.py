"""Vectorised hashing of words, shingles and characters over Arrow string columns.

All kernels work on whole texts, a few megabytes at a time, so that memory does not depend on the
size of an Arrow batch. A word is a maximal run of ASCII letters, digits and non-ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES, SEGMENT_BYTES = 2 << 20, 4 << 20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

WORD = np.zeros(256, bool)
WORD[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    WORD[_c] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def strings(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> pa.LargeStringArray:
    """A text column without nulls (null is empty), in lower case on request."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    return pc.utf8_lower(column) if lower else column


def raw(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string array."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(texts: pa.LargeStringArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.LargeStringArray]]:
    """(first row, rows) so that each piece has about ``limit`` bytes; one longer text stands alone."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, at + 60_000)
        yield at, texts.slice(at, end - at)
        at = end


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray | None = None, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """(hash, document, start byte, end byte) of every word, in order, and the hash of its first ``prefix`` bytes.

    Hashes are made a few megabytes at a time, cut between words, so only what is kept of each word grows with a text.
    """
    n = len(data)
    w = WORD[data] if is_word is None else is_word
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    parts, lo = [], 0
    while lo < n or not parts:
        hi = min(lo + SEGMENT_BYTES, n)
        while hi < n and w[hi] and not edge[hi]:
            more = np.flatnonzero(~w[hi : hi + SEGMENT_BYTES] | edge[hi : min(hi + SEGMENT_BYTES, n)])
            hi = hi + int(more[0]) if len(more) else min(hi + SEGMENT_BYTES, n)
        parts.append(_words(data[lo:hi], w[lo:hi], edge[lo : hi + 1], lo, prefix))
        lo = hi
    hashes, starts, ends, *more = (np.concatenate(p) for p in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]
    return hashes, np.searchsorted(offsets, starts, side="right") - 1, starts, ends, *more


def _words(data: np.ndarray, w: np.ndarray, edge: np.ndarray, lo: int, prefix: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    before[edge[:n]] = False
    after[edge[1:]] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    p, q = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * q[starts])
    if prefix:
        cut = np.minimum(starts + prefix, ends)
        return hashes, starts + lo, ends + lo, mix((sums[cut] - sums[starts]) * q[starts])
    return hashes, starts + lo, ends + lo


def shingles(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of ``size`` words; a shorter text with words is one shingle."""
    n = len(hashes)
    if not n:
        return hashes, doc
    h = np.zeros(n + size, np.uint64)
    d = np.full(n + size, -1, np.int64)
    h[:n], d[:n] = hashes, doc
    total, full = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(size):
        same = d[j : j + n] == d[:n]
        total = total * np.uint64(BASE) + np.where(same, h[j : j + n], np.uint64(0))
        full = same
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    take = full | first
    return mix(total[take]), doc[take]


def distinct(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(48-bit hash, document, count) of each document's different hashes, ordered by both."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    if not len(key):
        return key, doc.astype(np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return key & np.uint64((1 << 48) - 1), (key >> np.uint64(48)).astype(np.int64), count
