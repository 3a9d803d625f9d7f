"""PartEnum signatures for a Jaccard self-join of hashed sets.

Sizes are cut into bands.  A set takes part in the instance of its own band
and, if it is large enough to be three quarters of a set of the next band, in
that band's instance too.  An instance cuts the hash domain into first-level
groups, each into one or three second-level partitions, and enumerates the
partition subsets of a group (the one partition, or each pair of the three).
The signature of a subset hashes the set's elements that fall into it.

Two sets of sizes s and t with Jaccard similarity of 3/4 or more differ in at
most (s + t) / 7 elements.  With n groups and k differences at least
``agree(n, k)`` signatures agree.  Each set keeps all signatures but its
``agree - 1`` weakest ones, ranked by content alone; so the strongest agreeing
signature survives on both sides, and sufficiently similar sets always share
one.  Strength is rarity: the count, in a sketch of the corpus, of the rarest
element.  The sketch steers only the amount of work, never the result.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.wordhash import mix

GROWTH = 1.75
PAIRS_UP_TO = 96
SKETCH_BITS = 20


def linked(inter, size_a, size_b):
    """100 * intersection >= 75 * union, in integers."""
    return 100 * inter >= 75 * (size_a + size_b - inter)


def bands(largest: int) -> np.ndarray:
    """First size of each band, covering 1..largest and one band more."""
    first = [1]
    while first[-1] <= 2 * max(largest, 1):
        first.append(max(first[-1] + 1, int(first[-1] * GROWTH) + 1))
    return np.array(first, dtype=np.int64)


def _differences(size: int, low: int, high: int) -> int:
    """Most differing elements to a linked set whose size is in [low, high]."""
    partner = min(high, (4 * size) // 3)
    return (size + max(partner, min(size, high))) // 7


def _layout(low: int, high: int) -> tuple[int, int]:
    """(groups, partitions a group) of the instance for a band."""
    k = (2 * high) // 7
    return (k // 2 + 1, 3) if high <= PAIRS_UP_TO else (k + 1, 1)


def agree(groups: int, width: int, k: int) -> int:
    """Signatures that must agree when sets differ in k elements."""
    if width == 1:
        return groups - k
    return 3 * groups - 2 * k if k <= groups else 2 * groups - k


def signatures(values: np.ndarray, sketch: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signatures (uint64) of one set; ``values`` ascending and distinct."""
    size = len(values)
    if not size:
        return np.zeros(0, np.uint64)
    band = int(np.searchsorted(first, size, side="right")) - 1
    element = mix(values)
    rarity = sketch[values & np.uint64(len(sketch) - 1)]
    out = []
    while True:
        low, high = int(first[band]), int(first[band + 1]) - 1
        out.append(_instance(values, element, rarity, band, low, high))
        band += 1
        if 4 * size < 3 * int(first[band]):
            return np.concatenate(out)


def _instance(values, element, rarity, band: int, low: int, high: int) -> np.ndarray:
    groups, width = _layout(low, high)
    cells = groups * width
    cell = (((values >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    total = np.zeros(cells, dtype=np.uint64)
    rare = np.full(cells, np.iinfo(np.uint32).max, dtype=np.uint32)
    total[cell[starts]] = np.add.reduceat(element, starts)
    rare[cell[starts]] = np.minimum.reduceat(rarity, starts)
    if width == 3:
        t, r = total.reshape(-1, 3), rare.reshape(-1, 3)
        total = np.concatenate([t[:, 0] + t[:, 1], t[:, 0] + t[:, 2], t[:, 1] + t[:, 2]])
        rare = np.concatenate([np.minimum(r[:, 0], r[:, 1]), np.minimum(r[:, 0], r[:, 2]), np.minimum(r[:, 1], r[:, 2])])
    tag = np.arange(len(total), dtype=np.uint64) + (np.uint64(band + 1) << np.uint64(40))
    sig = mix(total + mix(tag))
    keep = len(sig) - agree(groups, width, _differences(len(values), low, high)) + 1
    if keep < len(sig):
        order = (rare.astype(np.uint64) << np.uint64(32)) | (sig >> np.uint64(32))
        sig = sig[np.argpartition(order, keep - 1)[:keep]]
    return sig
