"""Binary trie self-join of sorted fingerprints, level by level in numpy.

A node of the trie is a range of the sorted fingerprints. Pairs of nodes are
traversed together from a common root: at each bit the equal children keep the
pair's error count and the unequal ones add one; a pair beyond the budget, or
with an empty side, is dropped. Small pairs of ranges are compared directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of a frontier that are kept in memory, and the product of range sizes below which fingerprints are compared directly.
FRONTIER, DIRECT = 1 << 19, 48


def _expand(fps: np.ndarray, pairs: np.ndarray, budget: int, differ: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All linked (i, j) of pairs of ranges. differ: bits, per row, of blocks in which a pair must differ."""
    size = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(np.cumsum(size[a:]), 4 * FRONTIER)) + a)
        lo1, _, lo2, hi2 = pairs[:4, a:b]
        n = size[a:b]
        at = np.repeat(np.arange(b - a), n)
        off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width = (hi2 - lo2)[at]
        i, j = lo1[at] + off // width, lo2[at] + off % width
        keep = i < j
        i, j = i[keep], j[keep]
        x = fps[i] ^ fps[j]
        ok = np.bitwise_count(x) <= budget
        i, j, x = i[ok], j[ok], x[ok]
        if differ is not None and len(i):
            ok = np.ones(len(i), bool)
            for mask in differ[i].T:
                ok &= (mask == 0) | ((x & mask) != 0)
            i, j = i[ok], j[ok]
        if len(i):
            yield i, j
        a = b


def self_join(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: int, budget: int, differ: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of each range [lo, hi) whose fingerprints (uint64, sorted within a range) differ in `budget` bits at most.

    The fingerprints of a range agree above bit `top`.
    """
    roots = np.array([lo, hi, lo, hi, np.zeros(len(lo), np.int64)], np.int64)[:, hi - lo > 1]
    stack = [(top, roots)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        level, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            stack += [(level, pairs[:, :half]), (level, pairs[:, half:])]
            continue
        small = ((pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= DIRECT) | (level < 0)
        if small.any():
            yield from _expand(fps, pairs[:, small], budget, differ)
            pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        if level not in ones:
            ones[level] = np.append(0, np.cumsum((fps >> np.uint64(level)) & np.uint64(1), dtype=np.int64))
        count = ones[level]
        lo1, hi1, lo2, hi2, err = pairs
        mid1, mid2 = hi1 - (count[hi1] - count[lo1]), hi2 - (count[hi2] - count[lo2])
        same = lo1 == lo2
        parts = [(lo1, mid1, lo2, mid2, err), (mid1, hi1, mid2, hi2, err), (lo1, mid1, mid2, hi2, err + 1)]
        cross = (mid1[~same], hi1[~same], lo2[~same], mid2[~same], err[~same] + 1)
        new = np.concatenate([np.array(p, np.int64) for p in (*parts, cross)], axis=1)
        new = new[:, (new[4] <= budget) & (new[1] > new[0]) & (new[3] > new[2]) & ~((new[0] == new[2]) & (new[1] == new[3]) & (new[1] - new[0] < 2))]
        if new.shape[1]:
            stack.append((level - 1, new))


def forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of the links of a minimum spanning forest (Boruvka's rounds, vectorised)."""
    label, chosen = np.arange(n), np.zeros(len(i), bool)
    order = np.argsort(weight, kind="stable")
    i, j = i[order], j[order]
    live = np.arange(len(i))
    while len(live):
        a, b = label[i[live]], label[j[live]]
        live = live[a != b]
        if not len(live):
            break
        a, b = label[i[live]], label[j[live]]
        first = np.full(n, len(i), np.int64)
        np.minimum.at(first, a, live)
        np.minimum.at(first, b, live)
        take = np.unique(first[first < len(i)])
        chosen[take] = True
        # join the components along the links taken
        x, y = label[i[take]], label[j[take]]
        parent = np.arange(n)
        while True:
            lowest = np.minimum(parent[x], parent[y])
            before = parent.copy()
            np.minimum.at(parent, x, lowest)
            np.minimum.at(parent, y, lowest)
            parent = parent[parent]
            if (parent == before).all():
                break
        label = parent[label]
    return order[chosen]
