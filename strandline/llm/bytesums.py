"""Vectorised text primitives: many texts as one byte array, word hashes from running sums."""

from __future__ import annotations

from functools import cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@cache
def letters(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


_known: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = int(BASE)) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; a worker keeps the longest that it has needed."""
    if base not in _known or len(_known[base][0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _known[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _known[base]
    return up[:n], down[:n]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a line feed after each text, and where each text starts (with the end of the last)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    return data, starts


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix(data: np.ndarray, seed: int, base: int = int(BASE)) -> np.ndarray:
    """Running sums whose differences are hashes of substrings, see span_hash()."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0], sums = 0, out[1:]
    np.take(letters(seed), data, out=sums, mode="clip")  # in place: each array of this size costs as much as its sums
    np.multiply(sums, powers(len(data), base)[0], out=sums)
    np.cumsum(sums, out=sums)
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = int(BASE)) -> np.ndarray:
    """64-bit hashes of data[start:end]: equal bytes have equal hashes, wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), base)[1][starts] + (ends - starts).astype(np.uint64))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return data + ((data - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't ASCII white space."""
    white = np.ones(len(data) + 2, bool)
    np.logical_or((data - np.uint8(0x09)) < 5, data == 0x20, out=white[1:-1])
    edges = np.flatnonzero(white[1:] != white[:-1])
    return edges[::2], edges[1::2]
