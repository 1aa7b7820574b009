"""Hamming-distance links within groups of fingerprints, on vertical bit planes.

Plane ``p`` holds bit ``p`` of 64 neighbouring fingerprints in each machine
word, so that one XOR compares one bit of a query with 64 candidates. The
distances are kept in carry-save counters that are themselves bit-sliced; they
start at ``2**k - 1 - radius``, so a carry out of the top slice means that
the radius is exceeded. A word whose 64 lanes have all exceeded it is dropped
before the next planes are read.
"""

from __future__ import annotations

import numpy as np

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_SLAB = 1 << 15
#: Groups above this size are first thinned by comparing all with a few leaders.
_LEADERS_FROM, _LEADERS = 256, 6


def planes_of(prints: np.ndarray) -> np.ndarray:
    """``(n, words)`` fingerprints to ``(64 * words, ceil(n / 64))`` planes."""
    n, words = prints.shape
    padded = np.zeros((-(-n // 64) * 64, words), np.uint64)
    padded[:n] = prints
    out = np.empty((64 * words, len(padded) // 64), np.uint64)
    for w in range(words):
        for b in range(64):
            bits = ((padded[:, w] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
            out[64 * w + b] = np.packbits(bits, bitorder="little").view(np.uint64)
    return out


def near_lanes(planes: np.ndarray, prints: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int):
    """Of items (query row, plane word, mask of lanes), those with lanes within the radius."""
    slices = max(1, int(radius).bit_length())
    if (1 << slices) - 1 < radius:
        slices += 1
    bias = (1 << slices) - 1 - radius
    counters = [np.full(len(query), _ONES if bias >> i & 1 else np.uint64(0)) for i in range(slices)]
    lanes = lanes.copy()
    at = prints[query]
    for p in range(len(planes)):
        bit = (at[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)
        carry = planes[p][word] ^ (np.uint64(0) - bit)
        for i in range(slices):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        lanes &= ~carry
        if p % 4 == 3 and p + 1 < len(planes):
            live = lanes != 0
            if not live.all():
                if not live.any():
                    return query[:0], word[:0], lanes[:0]
                query, word, lanes, at = query[live], word[live], lanes[live], at[live]
                counters = [c[live] for c in counters]
    live = lanes != 0
    return query[live], word[live], lanes[live]


class Union:
    """Smallest-index labels under union, on whole arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                break
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def _masks(word, first, end):
    """Lanes of ``word`` that stand for rows in [first, end)."""
    low = np.clip(first - word * 64, 0, 64).astype(np.uint64)
    high = np.clip(end - word * 64, 0, 64).astype(np.uint64)
    below = lambda k: np.where(k >= 64, _ONES, (np.uint64(1) << (k & np.uint64(63))) - np.uint64(1))
    return below(high) & ~below(low)


def _compare(planes, prints, other, query, first, end, radius, confirm, union):
    """Link each query row to the rows of [first, end) within the radius."""
    words = np.maximum(0, (end - 1) // 64 - first // 64 + 1) * (end > first)
    starts = np.concatenate([[0], np.cumsum(words)])
    done = 0
    while done < len(query):
        upto = max(done + 1, int(np.searchsorted(starts, starts[done] + _SLAB, "right")) - 1)
        n = words[done:upto]
        item = np.repeat(np.arange(done, upto), n)
        word = first[item] // 64 + (np.arange(len(item)) - np.repeat(starts[done:upto] - starts[done], n))
        for s in range(0, len(item), _SLAB):
            i, w = item[s : s + _SLAB], word[s : s + _SLAB]
            q, w, lanes = near_lanes(planes, prints, query[i], w, _masks(w, first[i], end[i]), radius)
            if not len(q):
                continue
            bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(bits)
            a, b = q[row], w[row] * 64 + lane
            differ = union.label[a] != union.label[b]
            a, b = a[differ], b[differ]
            if other is not None and len(a):
                near = np.bitwise_count(other[a] ^ other[b]).sum(axis=1) <= confirm
                a, b = a[near], b[near]
            union.add(a, b)
        done = upto


def link_groups(prints: np.ndarray, sizes: np.ndarray, radius: int, other: np.ndarray | None = None, confirm: int = 0) -> np.ndarray:
    """Labels of the rows of consecutive groups: one row of each one's component, the same for all of it.

    Two rows of a group are linked if their ``prints`` differ in at most
    ``radius`` bits and, where ``other`` is given, those differ in at most
    ``confirm``. No pair is left out that could join two components: a large
    group is first compared with a few leaders, after which pairs inside the
    largest component so far need no comparison.
    """
    union = Union(len(prints))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    order = np.arange(len(prints))
    for g in np.flatnonzero(sizes >= _LEADERS_FROM):
        s, e = int(begins[g]), int(ends[g])
        own = np.arange(s, e)
        for k in range(_LEADERS):
            label = union.label[s:e]
            values, counts = np.unique(label, return_counts=True)
            if len(values) == 1:
                break
            lead = s if k == 0 else own[label != values[counts.argmax()]][0]
            near = np.bitwise_count(prints[own] ^ prints[lead]).sum(axis=1) <= radius
            if other is not None:
                near &= np.bitwise_count(other[own] ^ other[lead]).sum(axis=1) <= confirm
            hit = own[near]
            union.add(np.full(len(hit), lead), hit)
        label = union.label[s:e]
        values, counts = np.unique(label, return_counts=True)
        inside = label == values[counts.argmax()]
        order[s:e] = np.concatenate([own[~inside], own[inside]])
    moved = prints[order]
    back = Union(len(prints))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    back.add(place, place[union.label])
    planes = planes_of(moved)
    rows = np.arange(len(prints))
    end = np.repeat(ends, sizes)
    query_end = end.copy()
    for g in np.flatnonzero(sizes >= _LEADERS_FROM):
        s, e = int(begins[g]), int(ends[g])
        values, counts = np.unique(union.label[s:e], return_counts=True)
        query_end[e - int(counts.max()) : e] = 0  # both rows of such a pair are connected already
    _compare(planes, moved, None if other is None else other[order], rows, rows + 1, query_end, radius, confirm, back)
    label = np.empty_like(order)
    label[order] = order[back.label]
    return label
