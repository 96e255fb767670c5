"""Texts as numpy arrays of code points, and hashes of their runs."""

from __future__ import annotations

import functools

import numpy as np

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3


def kind(ch: str) -> int:
    return SPACE if ch.isspace() else LETTER if ch.isalpha() else DIGIT if ch.isdigit() else OTHER


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point of the basic plane."""
    return np.array([kind(chr(c)) for c in range(0x10000)], np.uint8)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def class_of(c: np.ndarray) -> np.ndarray:
    beyond = c > 0xFFFF
    if not beyond.any():
        return classes()[c]
    out = classes()[np.where(beyond, 0, c)]
    found, back = np.unique(c[beyond], return_inverse=True)
    out[beyond] = np.array([kind(chr(x)) for x in found.tolist()], np.uint8)[back]
    return out


def mix32(h: np.ndarray) -> np.ndarray:
    """Scrambles 32-bit values, in place."""
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return h


def mix64(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@functools.cache
def powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * 0x9E3779B97F4A7C15 % (1 << 64)
    return out


def block_factors(n: int) -> np.ndarray:
    """An odd factor for each of n blocks; the first is 1."""
    out = mix64(np.arange(n, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    out[0] = 1
    return out


def run_hashes(c: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each run c[start : start + length]; runs are in order and don't overlap."""
    if not len(starts):
        return np.empty(0, np.uint64)
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    inside = np.arange(total) - np.repeat(first, lengths)
    values = c[inside + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    values *= powers(1 << 12)[inside & 0xFFF]
    if int(lengths.max()) > 1 << 12:
        # in longer runs, each block of 4,096 has a factor of its own
        block = inside >> 12
        values *= block_factors(int(block.max()) + 1)[block]
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
