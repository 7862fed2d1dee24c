"""Sets of word n-grams as sorted 64-bit hashes, by numpy over the bytes of whole texts."""

from __future__ import annotations

import numpy as np

_M1, _M2, _STEP, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15), 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of x moves every bit of the result."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest text so far needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size, inverse = max(n, 1 << 16), np.uint64(pow(_BASE, -1, 1 << 64))
            for name, factor in (("up", np.uint64(_BASE)), ("down", inverse)):
                out = np.full(size, factor)
                out[0] = 1
                setattr(cls, name, np.multiply.accumulate(out))
        return cls.up, cls.down


def words(text: str | None) -> np.ndarray:
    """A hash for each word, A-Z lower-cased; words are separated by the six ASCII white-space characters."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _Powers.of(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of a shorter text the whole sequence as one; none without words."""
    w = words(text)
    if not len(w):
        return w
    width = min(size, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = mix(h * _M2 + w[k : len(w) - width + 1 + k])
    return np.unique(h)


def fingerprint(tokens: np.ndarray) -> int:
    """64 bits of a set, as a signed integer."""
    if not len(tokens):
        return 0
    # Arrays of one number wrap around without a warning, which scalars don't.
    total = mix(tokens ^ _M1).sum(dtype=np.uint64, keepdims=True) ^ (np.bitwise_xor.reduce(tokens, keepdims=True) * _M1)
    return int(mix(total + np.uint64(len(tokens))).view(np.int64)[0])
