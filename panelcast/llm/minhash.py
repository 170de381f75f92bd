"""Circulant MinHash: all coordinates of a signature from two permutations, one of them shifted."""

from __future__ import annotations

import hashlib

import numpy as np

from panelcast.llm import words

#: Words of a shingle, bands of a signature and coordinates of a band.
SHINGLE, BANDS, WIDTH = 5, 32, 4


def _sigma(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit universe: applied once, it breaks up any structure of the hashes."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _pi(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The second permutation, in place. Coordinate k takes the minimum of pi(sigma(shingle) + k)."""
    np.right_shift(x, np.uint32(17), out=room)
    np.bitwise_xor(x, room, out=x)
    np.multiply(x, np.uint32(0xED5AD4BB), out=x)
    np.right_shift(x, np.uint32(11), out=room)
    np.bitwise_xor(x, room, out=x)
    np.multiply(x, np.uint32(0xAC4C1B51), out=x)
    np.right_shift(x, np.uint32(15), out=room)
    np.bitwise_xor(x, room, out=x)
    np.multiply(x, np.uint32(0x31848BAB), out=x)
    np.right_shift(x, np.uint32(14), out=room)
    np.bitwise_xor(x, room, out=x)
    return x


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of shingle hashes of every row, one after the other, and where each begins.

    Words are lower-cased by A-Z. A row of fewer than n words has one shingle, all its words;
    a row without words has none.
    """
    start, end, ahead = words.spans(data, offsets)
    hashed = words.hashes(data, start, end, lower=True)
    windows = words.grams(hashed, n)
    sets = []
    for first, last in zip(ahead[:-1], ahead[1:], strict=True):
        if last - first >= n:
            own = np.sort(windows[first : last - n + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif last > first:
            sets.append(words.mix(words.grams(hashed[first:last], last - first) + np.uint64(last - first)))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def signatures(shingles: np.ndarray, begins: np.ndarray, coordinates: int) -> np.ndarray:
    """Rows x coordinates of 32-bit minima; only for rows that have a shingle."""
    out = np.full((len(begins) - 1, coordinates), np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(np.diff(begins) > 0)
    for first in range(0, len(full), 64):
        rows = full[first : first + 64]
        low, high = begins[rows[0]], begins[rows[-1] + 1]
        base = _sigma((shingles[low:high] >> np.uint64(32)).astype(np.uint32))
        edges, room, x = begins[rows] - low, np.empty_like(base), np.empty_like(base)
        for k in range(coordinates):
            np.add(base, np.uint32(k), out=x)
            out[rows, k] = np.minimum.reduceat(_pi(x, room), edges)
    return out


def band_keys(signature: np.ndarray, bands: int, width: int) -> np.ndarray:
    """One 64-bit key for each band, the band's number in it."""
    keys = np.zeros((len(signature), bands), np.uint64)
    for k in range(width):
        keys = words.mix(keys + signature[:, k : bands * width : width].astype(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return words.mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def identity(shingles: np.ndarray) -> bytes:
    """128-bit name of a set; sets with the same name are taken as equal."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
