"""Suffix trees of one sequence of numbers: Ukkonen's construction, and common extensions from an Euler tour.

A tree of n symbols holds at most 2n nodes (some 400 bytes a symbol while it is built); only the tour's depths and the
leaves' places outlive the construction.
"""

from __future__ import annotations

import numpy as np

#: Entries of the tour in one block; block minima go into the sparse table, so that it stays smaller than the tour.
BLOCK = 16


def ukkonen(s: list[int], sigma: int) -> tuple[list[int], list[int], dict[int, int]]:
    """(first symbol of the edge into each node, the place after its last, child by node * sigma + symbol).

    All symbols are below sigma, and the last one occurs nowhere else, so that every suffix ends in a leaf.
    """
    n = len(s)
    start, stop, link = [0], [0], [0]
    edge: dict[int, int] = {}
    node = at = length = remaining = 0
    for i, c in enumerate(s):
        unlinked = 0
        remaining += 1
        while remaining:
            if not length:
                at = i
            key = node * sigma + s[at]
            child = edge.get(key)
            if child is None:
                edge[key] = len(start)
                start.append(i), stop.append(n), link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                first = start[child]
                size = min(stop[child], i + 1) - first
                if length >= size:
                    node, length, at = child, length - size, at + size
                    continue
                if s[first + length] == c:
                    if unlinked:
                        link[unlinked] = node
                    length += 1
                    break
                split = len(start)
                edge[key] = split
                start.append(first), stop.append(first + length), link.append(0)
                edge[split * sigma + c] = split + 1
                start.append(i), stop.append(n), link.append(0)
                start[child] = first + length
                edge[split * sigma + s[first + length]] = child
                if unlinked:
                    link[unlinked] = split
                unlinked = split
            remaining -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - remaining + 1
    return start, stop, edge


class Extensions:
    """Longest common extensions of a sequence: the depth of the lowest common ancestor of two leaves of its tree."""

    def __init__(self, s: list[int], sigma: int):
        n = len(s)
        start, stop, edge = ukkonen(s, sigma)
        keys = np.fromiter(edge.keys(), np.int64, len(edge))
        order = np.argsort(keys)
        kids = np.fromiter(edge.values(), np.int64, len(edge))[order].tolist()
        del edge
        place = np.searchsorted(keys[order] // sigma, np.arange(len(start) + 1))
        following, last = place[:-1].tolist(), place[1:].tolist()
        depth = [0] * len(start)
        tour: list[int] = []
        leaves: list[int] = []
        seen = [0] * n
        path = [0]
        while path:  # children in the order of their symbols, each node again after every child
            v = path[-1]
            tour.append(depth[v])
            k = following[v]
            if k < last[v]:
                child = kids[k]
                following[v] = k + 1
                depth[child] = depth[v] + stop[child] - start[child]
                path.append(child)
            else:
                if stop[v] == n and v:
                    suffix = n - depth[v]
                    seen[suffix] = len(tour) - 1
                    leaves.append(suffix)
                path.pop()
        self.first = np.array(seen, np.int64)
        #: Place of each suffix among all in ascending order.
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        blocks = -(-len(tour) // BLOCK)
        depths = np.zeros(blocks * BLOCK, np.int32)
        depths[: len(tour)] = tour
        self.depths = depths.reshape(blocks, BLOCK)
        self.upto = np.minimum.accumulate(self.depths, axis=1)
        self.onward = np.minimum.accumulate(self.depths[:, ::-1], axis=1)[:, ::-1]
        self.table = [self.depths.min(axis=1)]
        while 2 << (len(self.table) - 1) <= blocks:
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at a and at b have in common from their starts; a and b differ."""
        low, high = np.minimum(self.first[a], self.first[b]), np.maximum(self.first[a], self.first[b])
        x, y = low // BLOCK, high // BLOCK
        out = np.minimum(self.onward[x, low % BLOCK], self.upto[y, high % BLOCK])
        same = np.flatnonzero(x == y)
        for k in range(BLOCK if len(same) else 0):
            inside = (low[same] % BLOCK <= k) & (k <= high[same] % BLOCK)
            value = np.where(inside, self.depths[x[same], k], np.iinfo(np.int32).max)
            out[same] = value if k == 0 else np.minimum(out[same], value)
        width = y - x - 1
        for level in range(len(self.table)):
            far = np.flatnonzero((width >> level) == 1)
            if len(far):
                row = self.table[level]
                out[far] = np.minimum(out[far], np.minimum(row[x[far] + 1], row[y[far] - (1 << level)]))
        return out.astype(np.int64)
