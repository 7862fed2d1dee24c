"""Suffix arrays and common prefixes of byte strings, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes after a text that reads beyond its end may see.
PAD = 72


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian integer; data has PAD more bytes at its end."""
    return little_words_at(data).byteswap()


def little_words_at(data: np.ndarray) -> np.ndarray:
    """The same with the first byte lowest, which is how the machine reads them."""
    data = np.ascontiguousarray(data)
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a padded text in the order of their first `depth` bytes at least, and the rank of each place.

    Larsson and Sadakane's refinement: after a sort by eight bytes, groups that are still mixed are sorted by the rank of
    the place h further on, and h doubles. Groups of one are never touched again.
    """
    n = len(data) - PAD
    key = words_at(data)[:n]
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order][1:] != key[order][:-1]]
    first = np.flatnonzero(fresh)
    rank = np.empty(n + PAD, np.int64)
    rank[n:] = np.arange(PAD) - PAD  # beyond the end, below all
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    h = 8
    while h < depth:
        size = np.diff(np.r_[first, n])
        mixed = np.repeat(size > 1, size)
        at = np.flatnonzero(mixed)
        if not len(at):
            break
        places = order[at]
        group, following = rank[places], rank[places + h]
        again = np.lexsort((following, group))
        places, group, following = places[again], group[again], following[again]
        order[at] = places
        new = np.r_[True, (group[1:] != group[:-1]) | (following[1:] != following[:-1])]
        fresh[at] = new
        first = np.flatnonzero(fresh)
        start = at[new]
        rank[places] = np.repeat(start, np.diff(np.r_[np.flatnonzero(new), len(at)]))
        h *= 2
    return order, rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int, lanes: int = 4096) -> np.ndarray:
    """Bytes that each suffix in order shares with the one before it, up to `limit`.

    Kasai's walk in the order of the text, in many lanes at once: from a place to the next the length falls by one at
    most, so each lane goes on where it was. Eight bytes are compared at a time.
    """
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    position = np.empty(n + 1, np.int64)
    position[order] = np.arange(n)
    position[n] = n
    key = words_at(data)
    lanes = max(1, min(lanes, n // 64))
    stride = -(-n // lanes)
    start = np.arange(lanes) * stride
    length, partner = np.zeros(lanes, np.int64), np.full(lanes, -1)
    shared = np.zeros(n, np.int64)
    for step in range(stride):
        at = start + step
        live = np.flatnonzero(at < n)
        place = at[live]
        other = before[place]
        # The bound holds if the place after the last partner stands before this one, which a sort to a limited depth
        # doesn't promise.
        bound = (other >= 0) & (partner[live] >= 0) & (position[partner[live] + 1] < position[place])
        known = np.where(bound, np.maximum(length[live] - 1, 0), 0)
        todo = np.flatnonzero((other >= 0) & (known < limit))
        while len(todo):
            x, y, k = place[todo], other[todo], known[todo]
            inside = (x + k < n) & (y + k < n)
            todo, x, y, k = todo[inside], x[inside], y[inside], k[inside]
            if not len(todo):
                break
            differ = key[x + k] ^ key[y + k]
            same = np.full(len(todo), 8)
            odd = differ != 0
            # The number of leading zero bytes, from the exponent of the value cut to its top bits.
            value = differ[odd]
            same[odd] = 7 - ((value > 0xFF).astype(np.int64) + (value > 0xFFFF) + (value > 0xFFFFFF) + (value > 0xFFFFFFFF) + (value > 0xFFFFFFFFFF) + (value > 0xFFFFFFFFFFFF) + (value > 0xFFFFFFFFFFFFFF))
            known[todo] = np.minimum(k + same, limit)
            todo = todo[(~odd) & (known[todo] < limit)]
        length[live], partner[live] = known, other
        shared[place] = known
    return shared[order]
