"""A prefix tree of ordered token sets and its join with other sets.

Sets are ascending runs of token ranks in one global order.  Sets with a common beginning share
nodes, so their partial overlap with a query is counted once.  A node is an edge of at most
EDGE tokens; a query leaves a subtree when its overlap so far and what both sides have left
cannot reach what the smallest set below requires.  All queries walk the tree level by level.
"""

from __future__ import annotations

import numpy as np

EDGE = 32  # tokens of a node
MARKS, LOOKUPS = 1 << 26, 1 << 22  # bytes of the table of query members, and its lookups at a time


class Sets:
    """Some sets: tokens by set, ascending; ``n`` counts all members, ``k`` the rows that have the set."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, k: np.ndarray, tokens: np.ndarray, size: np.ndarray):
        self.ids, self.n, self.k, self.tokens, self.size = ids, n, k, tokens, size
        self.begin = np.cumsum(size) - size

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, lo: int, hi: int) -> Sets:
        a, b = self.begin[lo], self.begin[hi - 1] + self.size[hi - 1]
        return Sets(self.ids[lo:hi], self.n[lo:hi], self.k[lo:hi], self.tokens[a:b], self.size[lo:hi])


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class PrefixTree:
    """Nodes in the order of their levels; the children of a node, and the sets that end in it, lie together."""

    def __init__(self, sets: Sets):
        self.sets = sets
        raw = sets.tokens.astype(">u4").tobytes()
        keys = [raw[4 * b : 4 * (b + s)] for b, s in zip(sets.begin.tolist(), sets.size.tolist(), strict=True)]
        self.order = np.array(sorted(range(len(sets)), key=keys.__getitem__), np.int64)
        rows = [sets.tokens[b : b + s] for b, s in zip(sets.begin[self.order], sets.size[self.order], strict=True)]
        size, n, begin = sets.size[self.order].tolist(), sets.n[self.order].tolist(), sets.begin[self.order].tolist()
        common = [-1]  # tokens that a set shares with the one before it
        for one, two in zip(rows, rows[1:], strict=False):
            k = min(len(one), len(two))
            differ = np.flatnonzero(one[:k] != two[:k])
            common.append(int(differ[0]) if len(differ) else k)
        ranges = [(0, len(sets), 0)]  # sets below each node and the length of its path
        edges, lower, ends = [(0, 0)], [], []
        at = 0
        while at < len(ranges):
            lo, hi, depth = ranges[at]
            at += 1
            a = lo
            while a < hi and size[a] == depth:
                a += 1
            ends.append((lo, a - lo))
            first = len(ranges)
            while a < hi:
                b = a + 1
                least = size[a]
                while b < hi and common[b] > depth:
                    least = min(least, common[b])
                    b += 1
                down = min(least, depth + EDGE)
                edges.append((begin[a] + depth, down - depth))
                ranges.append((a, b, down))
                a = b
            lower.append((first, len(ranges) - first))
        self.edge, self.length = np.array(edges, np.int64).T
        self.child, self.children = np.array(lower, np.int64).T
        self.end, self.ends = np.array(ends, np.int64).T
        self.least_n = np.array([min(n[lo:hi], default=0) for lo, hi, _ in ranges], np.int64)
        self.rest = np.array([max(size[lo:hi], default=0) - depth for lo, hi, depth in ranges], np.int64)
        self.last = sets.tokens[np.maximum(self.edge + self.length - 1, 0)] if len(sets.tokens) else np.zeros(len(ranges), np.int64)

    def linked(self, queries: Sets, universe: int, percent: int) -> np.ndarray:
        """Which sets (columns) each query (rows) links with: 100 * |shared| >= percent * |either|."""
        out = np.zeros((len(queries), len(self.sets)), bool)
        step = max(1, MARKS // max(universe, 1))
        for lo in range(0, len(queries), step):
            hi = min(lo + step, len(queries))
            self._walk(queries.take(lo, hi), universe, percent, out[lo:hi])
        return out

    def _walk(self, queries: Sets, universe: int, percent: int, out: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(queries)), queries.size)
        members = owner * universe + queries.tokens  # ascending
        mark = np.zeros(len(queries) * universe, np.uint8)
        mark[members] = 1
        stop = np.cumsum(queries.size)
        q, node, shared = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        while len(q):
            times = self.ends[node]
            who = np.repeat(np.arange(len(q)), times)
            y = self.order[spread(self.end[node], times)]
            x = q[who]
            hit = (100 + percent) * shared[who] >= percent * (queries.n[x] + self.sets.n[y])
            out[x[hit], y[hit]] = True

            times = self.children[node]
            who = np.repeat(np.arange(len(q)), times)
            node = spread(self.child[node], times)
            q, shared = q[who], shared[who] + self._met(mark, q[who] * universe, node)
            ahead = stop[q] - np.searchsorted(members, q * universe + self.last[node], "right")
            most = shared + np.minimum(ahead, self.rest[node])
            go = (100 + percent) * most >= percent * (queries.n[q] + self.least_n[node])
            q, node, shared = q[go], node[go], shared[go]

    def _met(self, mark: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """How many tokens of each node's edge a query has."""
        out = np.zeros(len(node), np.int64)
        step = LOOKUPS // EDGE
        for lo in range(0, len(node), step):
            part = node[lo : lo + step]
            size = self.length[part]
            token = self.sets.tokens[spread(self.edge[part], size)]
            found = mark[np.repeat(row[lo : lo + step], size) + token]
            out[lo : lo + step] = np.add.reduceat(found, np.cumsum(size) - size, dtype=np.int64)
        return out
