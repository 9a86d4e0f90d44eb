"""Texts as arrays of code points, and hashed character n-grams of them."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def kinds() -> np.ndarray:
    """Of each code point up to U+FFFF: 2 a letter, 1 another letter-like or digit, 0 neither."""
    return np.array([2 if (c := chr(i)).isalpha() else 1 if c.isalnum() else 0 for i in range(1 << 16)], np.uint8)


def spaced(text: str, least: int = 2) -> np.ndarray:
    """Lower-cased code points, with each run of what is neither letter nor (least 1) digit as one 0, and 0 at both ends."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    kept = np.where(x < 1 << 16, kinds()[np.minimum(x, (1 << 16) - 1)], 2) >= least
    x = np.concatenate([[0], np.where(kept, x, 0), [0]]).astype(np.uint64)
    return x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]


def segments(text: str, size: int = 1 << 19) -> Iterator[str]:
    """A very long text in parts that end at a space where there is one, so that arrays stay small."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        if end < 0 or end > at + 2 * size:
            end = at + size
        yield text[at:end]
        at = end
    yield text[at:]


def gram_buckets(x: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bucket of 2 ** bits for each n codes in a row."""
    h = np.full(max(0, len(x) - n + 1), n, np.uint64)
    for i in range(n):
        h = (h ^ x[i : len(x) - n + 1 + i]) * _MIX
        h ^= h >> np.uint64(29)
    return (h * _MIX >> np.uint64(64 - bits)).astype(np.int64)
