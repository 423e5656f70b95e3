"""Vectorised text kernels over Arrow string columns.

Everything works on the UTF-8 bytes of a record batch: words are the maximal
runs outside space and ``\\x09-\\x0D``, which are single bytes in UTF-8, so no
text is decoded.  A batch is cut into slices of a bounded number of bytes, so
memory does not follow the batch size; a text longer than the bound is a slice
of its own.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Rows of a slice, and bits of a shingle hash: both fit one 64-bit word.
SLICE_ROWS = 4096
HASH_BITS = 52
SHINGLE = 5
_MULT = 0x9E3779B97F4A7C15 | 1
_BASE = 0xD6E8FEB86659FD93 | 1
#: Spans up to so many bytes are hashed in step.
SHORT_SPAN = 64
#: Masks of the first 0 to 8 bytes of a little-endian word.
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ORDER = tuple(pow(_MULT, 2 * j + 3, 1 << 64) for j in range(SHINGLE))


def cached(key, make):
    """Per-process memo: Python workers are reused, so tables outlive a task."""
    store = sys.__dict__.setdefault("_attesta_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges [a, b) of at most ``limit`` bytes and 4096 rows, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, a + SLICE_ROWS, max(b, a + 1))
        yield a, b
        a = b


def _space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[32, *range(9, 14)]] = True
    return t


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


SPACE, LOWER = _space_table(), _lower_table()


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; offsets are relative to ``buf``."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[full] = inside[full]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans.

    Short spans are read eight bytes at a time, all spans in step, each word
    stirred in by a bijection; a longer span is one BLAKE2b digest.  Neither has
    inputs of a simple pattern that collide, as sums of powers modulo 2^64 have.
    """
    out = np.empty(len(start), np.uint64)
    size = end - start
    short = np.flatnonzero(size <= SHORT_SPAN)
    if len(short):
        padded = np.concatenate((buf, np.zeros(8, np.uint8)))
        word_at = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
        at, left = start[short], size[short]
        h = mix(left.astype(np.uint64) + np.uint64(_MULT))
        live = np.arange(len(short))
        while len(live):
            part = word_at[at[live]] & _HEAD[np.minimum(left[live], 8)]
            h[live] = mix((h[live] ^ part) + np.uint64(_BASE))
            at[live] += 8
            left[live] -= 8
            live = live[left[live] > 0]
        out[short] = h
    long = np.flatnonzero(size > SHORT_SPAN)
    if len(long):
        raw = memoryview(np.ascontiguousarray(buf))
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start[long].tolist(), end[long].tolist()))
        out[long] = np.frombuffer(digests, "<u8")
    return out


def windows(hashes: np.ndarray, row: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word index) of every window of ``size`` words inside a row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * np.uint64(_ORDER[j])
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return mix(total[at]), at


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 5-word shingles of A-Z-lowered texts as (row, hash), sorted.

    Hashes have 52 bits, so that a slice's rows and hashes sort as one word.

    A text of one to four words has one shingle, its whole sequence; a text
    without words has none.
    """
    low = LOWER[buf]
    start, end, row = words(low, offsets)
    h = span_hash(low, start, end)
    got, at = windows(h, row)
    rows, hashes = [row[at]], [got]
    counts = np.bincount(row, minlength=len(offsets) - 1) if len(row) else np.zeros(len(offsets) - 1, np.int64)
    lead = np.concatenate(([0], np.cumsum(counts)))
    for n in range(1, SHINGLE):
        few = np.flatnonzero(counts == n)
        if len(few):
            total = np.full(len(few), n, np.uint64)
            for j in range(n):
                total += h[lead[few] + j] * np.uint64(_ORDER[j])
            rows.append(few)
            hashes.append(mix(total))
    key = np.concatenate(rows).astype(np.uint64) << np.uint64(HASH_BITS) | np.concatenate(hashes) >> np.uint64(64 - HASH_BITS)
    key.sort()
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1)
