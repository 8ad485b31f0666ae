"""SetSketch: registers hold exponentially spaced, truncated minima of exponential variates.

Each of a set's elements spreads one variate over every register, in a random
order of registers and with the k-th smallest value in the k-th of equally
likely intervals (correlated sampling without replacement), so that a set of n
elements costs about n + m log m steps.  A register keeps floor(1 - log_b x)
of its smallest x, within 16 bits: sketches of a union are register maxima.

With b near 1 registers of two sets agree with a probability of about their
Jaccard similarity J, and u > v, u < v with those of an element of one set only
coming first; `jaccard` maximises that joint likelihood.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash

REGISTERS = 128
_LOG_BASE = math.log(1.002)
_SHIFT = 20_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, width: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; of all its words as one, if fewer than width; none without words."""
    own = text.encode().lower().split()  # bytes.lower: A-Z only
    w = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * _A + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def sketch(elements: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers (uint16) of a set of 64-bit hashes; m is a power of two."""
    low = np.ones(m)
    n = len(elements)
    if not n:
        return np.zeros(m, np.uint16)
    at = (elements & np.uint64(m - 1)).astype(np.int64)[:, None]
    step = ((elements >> np.uint64(16)) | np.uint64(1)).astype(np.int64)[:, None] & (m - 1)
    done, block = 0, min(m, max(1, math.ceil(m * (math.log(m) + 2) / n)))
    while done < m and low.max() > done / m:
        j = np.arange(done, min(m, done + block))
        u = (mix(elements[:, None] + (j.astype(np.uint64) + np.uint64(1)) * _A) >> np.uint64(11)).astype(float) * 2.0**-53
        np.minimum.at(low, ((at + step * j) & (m - 1)).ravel(), ((j + u) / m).ravel())
        done, block = done + len(j), max(1, block // 4)
    x = -np.log1p(-np.minimum(low, 1 - 2.0**-53))
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / _LOG_BASE) + _SHIFT, 0, 65535).astype(np.uint16)


def jaccard(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity, given how many registers of the first sketch are more, less or equal, and both set sizes."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    p, q = u * u * (equal + less), v * v * (equal + more)
    j = (p + q - np.sqrt((p - q) ** 2 + 4 * more * less * u * u * v * v)) / (2 * (more + less + equal) * u * v)
    return np.clip(j, 0, np.minimum(u / v, v / u))


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` (up to 4) registers of each sketch."""
    n, m = regs.shape
    parts = regs.reshape(n, m // rows, rows).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for k in range(rows):
        key = (key << np.uint64(16)) | parts[:, :, k]
    return mix(key * _A + mix(np.arange(1, m // rows + 1, dtype=np.uint64))).view(np.int64)
