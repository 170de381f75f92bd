"""Words of Arrow text columns as NumPy arrays: spans, hashes and shingles, without a Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time, unless one text alone is longer.
CHUNK = 1 << 20
#: Bytes of a word that are mixed eight at a time; the few longer words are hashed one by one.
LONG = 256
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the number of words ahead of it."""
    n = len(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words: eight bytes after eight are mixed into the hash of those ahead, then the length.

    Every step is a bijection that depends on all bytes so far, so texts made of the same blocks in another order differ.
    """
    padded = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    length = end - start
    out = mix(length.astype(np.uint64) * _STEP + _MIX_A)
    words = np.flatnonzero(length <= LONG)
    for at in range(0, LONG, 8):
        words = words[length[words] > at]
        if not len(words):
            break
        block = eight[start[words] + at] & _TAIL[np.minimum(length[words] - at, 8)]
        out[words] = mix((out[words] ^ block) + _STEP)
    for k in np.flatnonzero(length > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(padded[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n words; windows that cross rows are for the caller to leave out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += mix(words[k : len(words) - n + 1 + k] + np.uint64(k + 1)) * np.uint64(2 * k + 0x9E3779B1)
    return mix(total)
