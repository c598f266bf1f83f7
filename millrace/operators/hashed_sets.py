"""Hashed word shingles of Arrow text columns, vectorised over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
CHUNK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK, 1 << (n - 1).bit_length()) + 1
    if size not in _powers:
        up = np.full(size, U64(_BASE))
        down = np.full(size, U64(_BASE_INV))
        up[0] = down[0] = 1
        tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > CHUNK + 1:  # a table for one very long text is not kept
            return tables
        _powers[size] = tables
    return _powers[size]


def bytes_and_offsets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, A-Z in lower case, and each text's first word."""
    n = len(raw)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    up, down = _power_tables(n)
    low = _LOWER[raw]
    inner = ~_SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = inner.copy()
    begins[1:] &= ~inner[:-1] | edge[1:-1]
    finish = inner.copy()
    finish[:-1] &= ~inner[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(_BYTE[low] * up[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    return h, np.searchsorted(starts, offsets)


_BYTE = mix(np.arange(1, 257, dtype=U64))


def shingle_sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles.

    A text of fewer words has the whole sequence as its one shingle; a text without
    words, or null, has none. Work goes in chunks of about a megabyte of text.
    """
    raw, offsets = bytes_and_offsets(col)
    at, n = 0, len(col)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        to = min(to, n)
        own = offsets[at : to + 1] - offsets[at]
        h, first = word_hashes(raw[offsets[at] : offsets[to]], own)
        m = max(len(h) - k + 1, 0)
        grams = np.full(m, U64(k))
        for j in range(k):
            grams = mix(grams * U64(0xD1342543DE82EF95) + h[j : j + m])
        for i in range(to - at):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                short = np.array([b - a], dtype=U64)
                for x in h[a:b]:
                    short = mix(short * U64(0xD1342543DE82EF95) + x)
                yield short
            else:
                yield np.zeros(0, U64)
        at = to
