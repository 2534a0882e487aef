"""Sets of word shingles as 64-bit numbers."""

from __future__ import annotations

import numpy as np

WORDS = 5
BLOCK = 1 << 18
_rng = np.random.default_rng(20240607)
VALUE = _rng.integers(1, 1 << 64, 256, np.uint64, endpoint=False)
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept per worker."""
    if len(_powers[0]) < n:
        for k, x in enumerate((ODD, ODD_INVERSE)):
            steps = np.full(2 * n, x, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def spans_hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One number per byte range, from the byte values alone."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * up[:-1], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start])


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingles of a whole text; one for all words of a text with fewer."""
    parts = (text or "").encode().lower().split()  # lower-cases and splits at ASCII only
    if not parts:
        return np.empty(0, np.uint64)
    found = []
    for at in range(0, max(1, len(parts) - words + 1), BLOCK):
        data = np.frombuffer(b" ".join(parts[at:at + BLOCK + words - 1]) + b" ", np.uint8)
        ends = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        k = min(words, len(ends))
        found.append(spans_hashed(data, starts[:len(ends) - k + 1], ends[k - 1:]))
    return np.unique(np.concatenate(found))
