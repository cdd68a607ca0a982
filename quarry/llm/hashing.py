"""Rolling hashes of bytes and words, vectorised over whole pieces of text.

All arithmetic is on unsigned 64-bit integers and wraps.
"""

from __future__ import annotations

import numpy as np

#: An odd multiplier, so that it can be inverted modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word (a 64-bit finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for the bytes of every span [start, end) of ``data``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[data] * powers(BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` consecutive item hashes (len(items) - k + 1 of them)."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, factor in enumerate(powers(BASE, k + 1)[1:]):
        out += items[j : j + n] * factor
    return mix(out)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the rightmost minimum of each window of ``w`` values."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at, width = values, np.arange(len(values)), 1
    while width < w:
        step = min(width, w - width)
        right = low[step:] <= low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        width += step
    return at


def word_table(is_word) -> np.ndarray:
    """256 flags from a predicate on byte values."""
    return np.fromiter((is_word(b) for b in range(256)), bool, 256)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts with a gap after each; starts, ends and text number of every word."""
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    flags = np.zeros(len(data) + 2, bool)
    flags[1:-1] = table[data]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return data, starts, ends, np.searchsorted(bounds, starts, side="right")
