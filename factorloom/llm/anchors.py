"""Content-chosen anchors: every window of `length` bytes has one, found alike wherever the window stands."""

from __future__ import annotations

import numpy as np

from . import codes

GRAM = 32
_Q = 0x9E3779B97F4A7C15
_INVERSE = pow(_Q, -1, 1 << 64)
_HELD: dict[int, np.ndarray] = {}


def powers(q: int, n: int) -> np.ndarray:
    """q to the powers 0 to n - 1, modulo 2**64."""
    held = _HELD.get(q)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, q, np.uint64)]), dtype=np.uint64)
        _HELD[q] = held
    return held[:n]


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """Sums of scrambled bytes times powers, from which the hash of any stretch follows."""
    table = codes.mix64(np.arange(1, 257, dtype=np.uint64))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[b] * powers(_Q, len(b)), dtype=np.uint64)])


def stretch_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of b[start:end] for arrays of starts and ends."""
    h = (sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start]
    return codes.mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def least_in_windows(v: np.ndarray, w: int) -> np.ndarray:
    """For every window of w values, the place of the last of its least values."""
    n = len(v)
    pad = -n % w
    last = np.uint64(0xFFFFFFFFFFFFFFFF)
    # a value and its place compare as one number; later places are less among equal values
    high = v & ~np.uint64((1 << 24) - 1)
    key = high | (np.uint64((1 << 24) - 1) - np.arange(n, dtype=np.uint64))
    full = np.concatenate([key, np.full(pad, last)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    return (np.uint64((1 << 24) - 1) - (best & np.uint64((1 << 24) - 1))).astype(np.int64)


def anchored(b: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, hash of the stretch, first, last, the anchor's place): the windows of b that start at first to last have one anchor.

    The stretch is b[first : last + length]. Texts of 16 MB and more are done in overlapping parts by the caller.
    """
    n = len(b)
    if n < length:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    sums = prefix_sums(b)
    grams = stretch_hashes(sums, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    at = least_in_windows(grams, length - GRAM + 1)
    turn = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], turn])
    last = np.concatenate([turn - 1, [n - length]])
    # the stretch's hash also holds where the anchor stands in it, so that equal hashes are alike window by window
    where = (at[first] - first).astype(np.uint64)
    stretch = codes.mix64(stretch_hashes(sums, first, last + length) + where * np.uint64(0x9FB21C651E98DF25))
    return grams[at[first]], stretch, first, last, at[first]
