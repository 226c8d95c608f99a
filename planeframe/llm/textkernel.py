"""Vectorised hashing of words over the UTF-8 bytes of many texts at once (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in runs of about so many bytes (a longer text makes a run of its own).
RUN_BYTES = 512 << 10

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur style)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        both = []
        for r in (_R, _R_INV):
            p = np.full(max(n, RUN_BYTES + 4096), r, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers = tuple(both)
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; a null is an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each."""
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def word_bounds(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of its first word (n + 1 values)."""
    if not len(body):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~WHITE[body]
    begin, last = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    filled = off[:-1][off[1:] > off[:-1]]
    begin[filled] = word[filled]
    last[filled[1:] - 1] |= word[filled[1:] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


_PLUS_ONE = np.arange(1, 257, dtype=np.uint64)


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _PLUS_ONE) -> np.ndarray:
    """64-bit hashes of the byte ranges: equal bytes give equal hashes wherever they stand. values: of each byte."""
    p, inv = powers(len(body) + 1)
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(values[body] * p[: len(body)], out=total[1:])
    raw = (total[ends] - total[starts]) * inv[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, with A-Z in lower case, and the number of each text's first word."""
    body = LOWER[body]
    starts, ends, first = word_bounds(body, off)
    return span_hashes(body, starts, ends), first


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles; with fewer words, all of them as one; none without words."""
    n = max(0, len(hashes) - k + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n] + np.uint64(j + 1))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(acc[a : b - k + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                one = mix(one * np.uint64(0xA24BAED4963EE407) + hashes[i : i + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
