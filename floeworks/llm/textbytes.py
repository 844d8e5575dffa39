"""Vectorised words and hashes over the UTF-8 buffers of Arrow string columns.

A word is a run of bytes outside 0x09-0x0D and 0x20. Every byte of a multi-byte character is
above 0x7F, so byte rules and character rules agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of BASE ("up") or of its inverse mod 2**64 ("down"); kept and grown."""
    have = _powers[kind]
    if len(have) < n:
        step = BASE if kind == "up" else BASE_INVERSE
        size = 1 << max(12, int(n - 1).bit_length())
        grown = np.full(size, step, np.uint64)
        grown[0] = 1
        have = _powers[kind] = np.multiply.accumulate(grown)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection on 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about limit bytes (a longer row comes alone): first, end, bytes, offsets."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and per row the number of words before it (one more entry than rows)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with (h[j] - h[i]) * BASE**-i a polynomial hash mod 2**64 of bytes i..j-1."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    down = _power("down", len(h))
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words of one text; of the whole sequence if it has fewer, none without words."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    runs = max(1, n - width + 1)
    out = np.zeros(runs, np.uint64)
    for k in range(min(width, n)):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + word_hashes[k : k + runs])
    return out


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text, A-Z lower-cased."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]))
    return np.unique(shingle_hashes(span_hash(prefix_hash(data), starts, ends), width))
