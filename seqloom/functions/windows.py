"""Vectorised hashing of all character windows of many texts.

A batch of texts is laid out as one array of code points; every window of
length k is hashed by doubling (h_2n[i] = h_n[i] * B^n + h_n[i+n]), so the
cost is O(log k) passes and no Python loop runs over characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_33 = np.uint64(33)
_MASK = (1 << 64) - 1
HASH_BITS = 46
MAX_ROWS = 1 << (64 - HASH_BITS)


def mix64(h: np.ndarray) -> np.ndarray:
    """Avalanche step on unsigned 64-bit values (a bijection)."""
    h = h ^ (h >> _33)
    h *= _M1
    h ^= h >> _33
    h *= _M2
    h ^= h >> _33
    return h


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offset of each text."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if joined.isascii():
        return np.frombuffer(joined.encode("ascii"), np.uint8), offsets
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def polynomial(values: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every k consecutive values."""
    n = len(values)
    if n < k:
        return np.empty(0, np.uint64)
    power = lambda e: np.uint64(pow(BASE, e, 1 << 64))
    done, done_len, cur, cur_len = None, 0, values, 1
    while True:
        if k & 1:
            if done is None:
                done, done_len = cur, cur_len
            else:
                m = n - done_len - cur_len + 1
                done = done[:m] * power(cur_len) + cur[done_len : done_len + m]
                done_len += cur_len
        k >>= 1
        if not k:
            return done
        m = n - 2 * cur_len + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        cur = cur[:m] * power(cur_len) + cur[cur_len : cur_len + m]
        cur_len *= 2


def window_hashes(codes: np.ndarray, offsets: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start) of every window of k codes that lies inside one row."""
    table = mix64(np.arange(256, dtype=np.uint64) + np.uint64((seed * BASE + 1) & _MASK))
    values = table[codes] if codes.dtype == np.uint8 else mix64(codes.astype(np.uint64) + np.uint64((seed * BASE + 1) & _MASK))
    h = polynomial(values, k)
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[: len(h)]
    start = np.arange(len(h), dtype=np.int64)
    inside = start + k <= offsets[1:][rows] if len(h) else np.zeros(0, bool)
    if inside.all():
        return mix64(h), rows, start - offsets[:-1][rows]
    h, rows, start = h[inside], rows[inside], start[inside]
    return mix64(h), rows, start - offsets[:-1][rows]


def chunks(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `chars` characters together (one row at least,
    `MAX_ROWS` at most)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and (size + len(t) > chars or i - begin >= MAX_ROWS):
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def distinct_per_row(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, row), ordered by row, then hash; of a hash the upper
    `HASH_BITS` bits count and are kept. Row and hash share one 64-bit key, so
    this is a single sort."""
    low = np.uint64(64 - HASH_BITS)
    key = (rows.astype(np.uint64) << np.uint64(HASH_BITS)) | (h >> low)
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key << low, (key >> np.uint64(HASH_BITS)).astype(np.int32)


def rank_in_row(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """0-based rank of each entry within its (ascending) row."""
    counts = np.bincount(rows, minlength=n_rows)
    starts = np.zeros(n_rows + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    return np.arange(len(rows), dtype=np.int64) - starts[:-1][rows]
