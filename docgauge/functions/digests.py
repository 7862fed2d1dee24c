"""MD5 of many short texts at once, in numpy.

The functions are made inside a function, so that Spark sends them to its workers by value: nothing need be installed there.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

_SINES = [int(abs(math.sin(k + 1)) * 2**32) & 0xFFFFFFFF for k in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_PLACES = [[k % 16 for k in range(16)], [(5 * k + 1) % 16 for k in range(16)], [(3 * k + 5) % 16 for k in range(16)], [7 * k % 16 for k in range(16)]]


def keys_of():
    """A function (prefix, ids) -> (high, low): the MD5 of prefix|id as two unsigned numbers each, whose order is that of the hexadecimal digests. A null id leaves the prefix alone."""
    sines, turns, places, step = _SINES, _TURNS, _PLACES, 8192

    def digest(words: list, n: int) -> np.ndarray:
        """The four words of the digests of one-block messages; words: sixteen numbers or arrays."""
        start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
        a, b, c, d = (np.full(n, x, np.uint32) for x in start)
        f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
        for k in range(64):
            part = k // 16
            if part == 0:  # d ^ (b & (c ^ d))
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif part == 1:  # c ^ (d & (b ^ c))
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif part == 2:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:  # c ^ (b | ~d)
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            word = words[places[part][k % 16]]
            np.add(a, f, out=a)
            if isinstance(word, int):
                np.add(a, np.uint32((word + sines[k]) & 0xFFFFFFFF), out=a)
            else:
                np.add(a, word, out=a)
                np.add(a, np.uint32(sines[k]), out=a)
            turn = turns[part][k % 4]
            np.left_shift(a, np.uint32(turn), out=t)
            np.right_shift(a, np.uint32(32 - turn), out=a)
            np.bitwise_or(a, t, out=a)
            np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
        return np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), start, strict=True)], axis=1)

    def hashed(prefix: bytes, ids: np.ndarray) -> np.ndarray:
        """Digests of prefix + id; ids: bytes of one length, a row each."""
        n, size = ids.shape
        whole = len(prefix) + size
        out = np.empty((n, 4), np.uint32)
        if whole > 55:
            for i in range(n):
                out[i] = np.frombuffer(hashlib.md5(prefix + ids[i].tobytes()).digest(), "<u4")
            return out
        block = np.zeros((n, 64), np.uint8)
        block[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
        block[:, len(prefix) : whole] = ids
        block[:, whole] = 0x80
        block[:, 56], block[:, 57] = 8 * whole & 255, 8 * whole >> 8
        words = block.view("<u4")
        vary = range(len(prefix) // 4, (whole + 3) // 4 if size else 0)
        for x in range(0, n, step):
            part = words[x : x + step]
            out[x : x + step] = digest([np.ascontiguousarray(part[:, k]) if k in vary else int(part[0, k]) for k in range(16)], len(part))
        return out

    def keys(prefix: str, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = ids.cast(pa.large_binary())
        offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        data = np.frombuffer(ids.buffers()[2] or b"", np.uint8)
        there = ids.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.where(there, np.diff(offsets), -1)
        out = np.empty((len(ids), 4), np.uint32)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            if size < 0:
                out[at] = hashed(prefix.encode(), np.empty((1, 0), np.uint8))
            else:
                out[at] = hashed(f"{prefix}|".encode(), data[offsets[at][:, None] + np.arange(size)] if size else np.empty((len(at), 0), np.uint8))
        w = out.byteswap().astype(np.uint64)
        return w[:, 0] << np.uint64(32) | w[:, 1], w[:, 2] << np.uint64(32) | w[:, 3]

    return keys
