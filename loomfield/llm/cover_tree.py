"""Cover trees over integer points, and dual-tree assignment of the points of one to the nearest points of another.

A node has a centre among its points and a radius that covers them. Its children's centres lie more than half the
radius' power of two apart, cover its points within that distance, and its own centre is one of them. Points of a node
are neighbours in the tree's order, so a node is a range. Leaves hold a few points, or many equal ones.
"""

from __future__ import annotations

import numpy as np

LEAF = 8
#: Components and distances up to here are exact in doubles, which are faster than integers.
EXACT = 1 << 22


class CoverTree:
    """``points`` in the tree's order; ``order`` says where each stood. Per node: centre, radius, range, children."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        wide = points.astype(np.float64)
        norm = (wide**2).sum(1)
        square = np.maximum(norm[:, None] + norm - 2 * (wide @ wide.T), 0)
        # rounding of large components only widens the radii
        apart = np.sqrt(square + (float(norm.max()) * 2.0**-40 if n and np.abs(points).max() > EXACT else 0.0))
        self.order = np.zeros(n, np.int64)
        centre, radius, lo, hi, child, children = [], [], [], [], [], []
        queue = [(0, np.arange(n), 0)] if n else []
        at = 0
        while at < len(queue):
            c, members, begin = queue[at]
            at += 1
            r = float(apart[c, members].max())
            centre.append(c)
            radius.append(r)
            lo.append(begin)
            hi.append(begin + len(members))
            child.append(len(queue))
            before = len(queue)
            if r > 0 and len(members) > leaf:
                scale = 2.0 ** (np.ceil(np.log2(r)) - 1)
                left = members
                while len(left):
                    near = (apart[c, left] <= scale) | (left == c)
                    own = left[near]
                    queue.append((int(c), own, begin))
                    begin += len(own)
                    left = left[~near]
                    c = left[0] if len(left) else c
            else:
                self.order[begin : begin + len(members)] = members
            children.append(len(queue) - before)
        place = np.zeros(n, np.int64)
        place[self.order] = np.arange(n)
        self.points = points[self.order]
        self.centre = place[np.array(centre, np.int64)]
        self.radius = np.array(radius)
        self.lo, self.hi, self.child, self.children = (np.array(x, np.int64) for x in (lo, hi, child, children))

    PARTS = ("centre", "radius", "lo", "hi", "child", "children")

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in self.PARTS]

    @classmethod
    def of(cls, points: np.ndarray, parts: list[np.ndarray]) -> CoverTree:
        """A tree from its stored points, which stand in its order, and ``parts``."""
        tree = cls.__new__(cls)
        tree.points, tree.order = points, np.arange(len(points))
        for name, part in zip(cls.PARTS, parts):
            setattr(tree, name, part)
        return tree


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x and y, as 64-bit integers."""
    if len(x) and max(np.abs(x).max(), np.abs(y).max()) <= EXACT:
        return ((x.astype(np.float64) - y) ** 2).sum(-1).astype(np.int64)
    return ((x.astype(np.int64) - y) ** 2).sum(-1)


def _ranges(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For concatenated ranges: whose each entry is, and the entry."""
    own = np.repeat(np.arange(len(begin)), length)
    return own, begin[own] + np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)


def nearest(tree: CoverTree, others: CoverTree) -> tuple[np.ndarray, dict[str, int]]:
    """For each point of ``tree``, in its order, the number of the nearest point of ``others`` (ties: smaller number),
    and how many pairs were compared or pruned.

    All pairs of a node of ``tree`` go down together: to the other tree's children where these are the wider ones,
    else to the node's own. A pair goes once it is farther at its nearest than another pair at its farthest, so
    pairs at equal distance stay and are compared exactly.
    """
    n = len(tree.points)
    answer, found = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    bound = np.full(len(tree.lo), np.inf)
    q, r = np.zeros(1 if n else 0, np.int64), np.zeros(1 if n else 0, np.int64)
    seen = {"node_pairs": 0, "pruned": 0, "whole_nodes": 0, "point_pairs": 0}
    rounding = 1e-9
    while len(q):
        seen["node_pairs"] += len(q)
        d = np.sqrt(squared(tree.points[tree.centre[q]], others.points[others.centre[r]]).astype(np.float64))
        np.minimum.at(bound, q, d + tree.radius[q])
        near = d - tree.radius[q] - others.radius[r] <= bound[q] * (1 + rounding) + rounding
        seen["pruned"] += int((~near).sum())
        q, r = q[near], r[near]
        order = np.argsort(q, kind="stable")
        q, r = q[order], r[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        size = np.diff(np.concatenate((first, [len(q)])))
        node = q[first]
        inner = others.children[r] > 0
        widest = np.maximum.reduceat(np.where(inner, others.radius[r], -1.0), first)
        leaf = tree.children[node] == 0
        down_other = (widest >= 0) & (leaf | (widest >= tree.radius[node]))
        whole = (widest < 0) & (size == 1) & (others.hi[r[first]] - others.lo[r[first]] == 1)
        exact = ~whole & (widest < 0) & leaf
        down_own = ~(down_other | whole | exact)
        kind = np.repeat(np.arange(len(node)), size)
        # one centroid is left for a whole node
        own, row = _ranges(tree.lo[node[whole]], (tree.hi - tree.lo)[node[whole]])
        answer[row] = others.order[others.lo[r[first[whole]]]][own]
        seen["whole_nodes"] += int(whole.sum())
        # leaves: every point with every centroid that is left
        pair = np.flatnonzero(exact[kind])
        own, row = _ranges(tree.lo[q[pair]], (tree.hi - tree.lo)[q[pair]])
        leaf_of = r[pair][own]
        again, far = _ranges(others.lo[leaf_of], (others.hi - others.lo)[leaf_of])
        row, number = row[again], others.order[far]
        if len(row):
            distance = squared(tree.points[row], others.points[far])
            seen["point_pairs"] += len(row)
            best = np.lexsort((number, distance, row))
            best = best[np.concatenate(([True], row[best][1:] != row[best][:-1]))]
            answer[row[best]], found[row[best]] = number[best], distance[best]
        # pairs of nodes that go on
        x = np.flatnonzero(down_other[kind])
        fixed, x = x[others.children[r[x]] == 0], x[others.children[r[x]] > 0]
        own, below = _ranges(others.child[r[x]], others.children[r[x]])
        y = np.flatnonzero(down_own[kind])
        own_y, below_y = _ranges(tree.child[q[y]], tree.children[q[y]])
        bound[below_y] = np.minimum(bound[below_y], bound[q[y]][own_y])
        q, r = np.concatenate((q[fixed], q[x][own], below_y)), np.concatenate((r[fixed], below, r[y][own_y]))
    return answer, seen
