"""Average linkage of sparse vectors in memory that follows their entries, without a matrix of distances.

Two clusters' mean cosine distance is 1 less the product of their vectors'
sums over both sizes, so sums stand in for distances. Clusters merge at most at
the threshold only where some pair of theirs is that near; so vectors that no
chain of such pairs joins are never compared again, and each chain's vectors
are merged alone, with the same result.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np

#: Slack of the search for near pairs. A pair too many joins two chains and changes no result. Fixed value.
SLACK = 1e-9


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several ranges, one after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def near_chains(ptr: np.ndarray, col: np.ndarray, weight: np.ndarray, length: np.ndarray, least: float, at_once: int) -> np.ndarray:
    """A number for each vector, the same for those that a chain of pairs with a cosine of least or more joins.

    Vector i has the columns col[ptr[i]:ptr[i + 1]], in any order (they are put
    in another), each with its positive weight, and at least the length they
    make. A vector's commonest columns whose part is shorter than least are
    left out of the index: a pair that shares no other column is not near.
    at_once is the number of a vector's columns looked up at once.
    """
    n = len(length)
    chain = np.arange(n)
    if least <= 0:
        return np.zeros(n, dtype=np.int64)
    often = np.bincount(col, minlength=len(weight))
    by_often = np.argsort(often, kind="stable")
    rank = np.empty(len(weight), dtype=col.dtype)
    rank[by_often] = np.arange(len(weight))
    weight, often = weight[by_often], often[by_often]
    col[:] = rank[col]
    alone = int(np.searchsorted(often, 2))  # columns of one vector are in no product
    split, start, rest, shared = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64), np.zeros(n), np.zeros(n)
    for i in range(n):
        c = col[ptr[i]:ptr[i + 1]]
        c.sort()
        start[i] = ptr[i] + np.searchsorted(c, alone)
        after = np.append(np.cumsum(weight[col[start[i]:ptr[i + 1]][::-1]] ** 2)[::-1], 0.0) / length[i] ** 2  # squares of a column and the later ones
        k = int((after >= (0.999 * least) ** 2).sum())
        split[i], rest[i], shared[i] = start[i] + k, np.sqrt(after[k]), np.sqrt(after[0])
    listed = np.empty((split - start).sum(), dtype=np.int64)
    at = 0
    for i in range(n):
        c = col[start[i]:split[i]]
        listed[at:at + len(c)] = c.astype(np.int64) * n + i
        at += len(c)
    listed.sort()
    p_ptr = np.searchsorted(listed, np.arange(len(weight) + 1, dtype=np.int64) * n)
    p_row = np.empty(len(listed), dtype=np.int32)
    for lo in range(0, len(listed), 1 << 20):
        p_row[lo:lo + (1 << 20)] = listed[lo:lo + (1 << 20)] % n
    del listed
    dense = np.zeros(len(weight))
    for x in range(1, n):
        c = col[start[x]:ptr[x + 1]]
        w = weight[c] ** 2
        part = np.zeros(n)
        for lo in range(0, len(c), at_once):
            some = c[lo:lo + at_once]
            lengths = p_ptr[some + 1] - p_ptr[some]
            part += np.bincount(p_row[_ranges(p_ptr[some], lengths)], np.repeat(w[lo:lo + at_once], lengths), minlength=n)
        part = part[:x] / (length[:x] * length[x])
        maybe = np.flatnonzero((part >= least - rest[:x] * shared[x] - SLACK) & (chain[:x] != chain[x]))
        if not len(maybe):
            continue
        dense[c] = w
        whole = part[maybe]
        for lo in range(0, len(maybe), at_once):
            some = maybe[lo:lo + at_once]
            lengths = ptr[some + 1] - split[some]
            whole[lo:lo + at_once] += np.bincount(np.repeat(np.arange(len(some)), lengths), dense[col[_ranges(split[some], lengths)]], minlength=len(some)) / (length[some] * length[x])
        dense[c] = 0.0
        joined = np.unique(chain[maybe[whole >= least - SLACK]])
        if len(joined):
            joined = np.append(joined, chain[x])
            chain[np.isin(chain, joined)] = joined.min()
    return chain


def merge_near(row: np.ndarray, col: np.ndarray, val: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """For each of the vectors the first vector of its cluster, by average linkage cut at threshold; size is how many times a vector counts.

    The nearest pair merges first, of equals (to 12 places) the first. Each
    cluster keeps its nearest later one; merges bring none nearer, so that
    is a bound until it is looked up again.
    """
    m = len(size)
    col = np.unique(col, return_inverse=True)[1]
    width = int(col.max()) + 1 if len(col) else 1
    val = val * size[row]
    label, count, alive, stamp = np.arange(m), size.astype(float), np.ones(m, dtype=bool), [0] * m
    heap: list[tuple] = []

    def look_up(a: int) -> None:
        mine = label[row] == a
        total = np.bincount(col[mine], val[mine], minlength=width)
        dots = np.bincount(label, np.bincount(row, val * total[col], minlength=m), minlength=m)[a + 1:]
        d = np.where(alive[a + 1:], np.round(1 - dots / (count[a] * count[a + 1:]), 12), np.inf)
        if len(d) and d[k := int(np.argmin(d))] <= threshold:
            heapq.heappush(heap, (float(d[k]), a, a + 1 + k, stamp[a], stamp[a + 1 + k]))

    for a in range(m - 1):
        look_up(a)
    while heap:
        _, a, b, sa, sb = heapq.heappop(heap)
        if stamp[a] != sa:
            continue
        if stamp[b] == sb:
            label[label == b] = a
            count[a] += count[b]
            alive[b] = False
            stamp[a], stamp[b] = stamp[a] + 1, stamp[b] + 1
        look_up(a)
    return label


def clusters(ptr: np.ndarray, col: np.ndarray, weight: np.ndarray, length: np.ndarray, whole: np.ndarray, threshold: float, at_once: int) -> np.ndarray:
    """Cluster numbers, in the order of first members, of vectors as near_chains takes them: average linkage of cosine distances cut at threshold.

    Columns of one vector only may be left out, not of its length; whole says
    for each vector that none is. Whole vectors of the same columns are one
    vector that counts as often.
    """
    n = len(length)
    seen: dict[bytes, int] = {}
    same = np.arange(n)
    for i in range(n):
        c = col[ptr[i]:ptr[i + 1]]
        c.sort()
        if whole[i]:
            same[i] = seen.setdefault(hashlib.sha256(c.tobytes()).digest(), i)
    del seen
    first, at = np.unique(same, return_inverse=True)
    size = np.bincount(at)
    if len(first) < n:
        lengths = np.diff(ptr)[first]
        kept = np.zeros(len(col), dtype=bool)
        for i in first:
            kept[ptr[i]:ptr[i + 1]] = True
        col, ptr, length = col[kept], np.append(0, np.cumsum(lengths)), length[first]
        del kept
    names = col.copy()
    chain = near_chains(ptr, col, weight, length, 1 - threshold, at_once)
    col = names
    root = np.arange(len(first))
    order = np.argsort(chain, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(chain[order])) + 1):
        if len(members) > 1:
            lengths = ptr[members + 1] - ptr[members]
            row, c = np.repeat(np.arange(len(members)), lengths), col[_ranges(ptr[members], lengths)]
            root[members] = members[merge_near(row, c, weight[c] / length[members][row], size[members], threshold)]
    return np.unique(root[at], return_inverse=True)[1]
