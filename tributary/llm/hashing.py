"""Rolling hashes and words over byte buffers, in numpy."""

from __future__ import annotations

import functools

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes that are hashed at a time; bounds what one call holds.
SPAN = 1 << 18


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse mod 2**64, for i < size."""

    def run(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of uint64 values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sums(values: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] the polynomial of values[i:j], shifted by i."""
    up, _ = powers(len(values))
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up, out=c[1:])
    return c


def between(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end) of what c sums."""
    _, down = powers(len(c))
    return mixed((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every stretch of n values, by its start."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    c = sums(values)
    _, down = powers(len(values))
    return mixed((c[n:] - c[:-n]) * down[: len(values) - n + 1] + np.uint64(n))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width values in a row, from running minima of blocks."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    pad = -len(h) % width
    x = np.concatenate([h, np.full(pad, np.iinfo(h.dtype).max, h.dtype)]) if pad else h
    x = x.reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the rows that lie between offsets, and the first word of each row (with their number last)."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    fresh = inside[1:-1] & ~inside[:-2]
    over = inside[1:-1] & ~inside[2:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    fresh[cut] |= inside[cut + 1]
    over[cut - 1] |= inside[cut]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(over) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, a bounded stretch of bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SPAN)))
        low = starts[at]
        c = sums(data[low : ends[to - 1]])
        out[at:to] = between(c, starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n word hashes in a row."""
    if len(words) < n:
        return words[:0]
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return h
