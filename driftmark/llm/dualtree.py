"""Nearest entries of many points by two trees, with whole numbers throughout.

One tree halves the points at the median of their widest side, another the entries. Pairs of nodes
are followed downwards from the two roots. A pair goes when the least distance of its boxes is more
than some other entry node can be away at most; a node of points with one entry left is assigned
as a whole, with its sum and count; points of the lowest nodes get exact distances to the entries
left. All pairs of a level are worked on together.
"""

from __future__ import annotations

import numpy as np

LEAF = 16
#: Distances are kept next to the entry's index in one 64-bit number.
MOST_ENTRIES = 1 << 10
MOST_DISTANCE = 1 << 52


def halved(points: np.ndarray, depth: int) -> np.ndarray:
    """Order of the points in which ``bounds(n, level)`` cuts the nodes of every level."""
    order = np.arange(len(points), dtype=np.int64)
    if not points.shape[1]:
        return order
    for level in range(depth):
        cuts = bounds(len(points), level)
        inside = points[order]
        low, high = (f.reduceat(inside, cuts[:-1], axis=0) for f in (np.minimum, np.maximum))
        node = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        side = (high - low).argmax(1)[node]
        order = order[np.lexsort((inside[np.arange(len(inside)), side], node))]
    return order


def bounds(n: int, level: int) -> np.ndarray:
    return (n * np.arange((1 << level) + 1)) >> level


def depth_of(n: int, leaf: int) -> int:
    """Levels below the root so that a node holds ``leaf`` points or a few more, and none is empty."""
    return max(0, (n // max(leaf, 1)).bit_length() - 1)


class Tree:
    """Boxes, sums and places of the nodes, level by level."""

    def __init__(self, points: np.ndarray, order: np.ndarray, depth: int):
        self.order, self.depth, self.points = order, depth, points[order]
        self.cuts = [bounds(len(points), level) for level in range(depth + 1)]
        ends = [c[:-1] for c in self.cuts]
        self.low = [np.minimum.reduceat(self.points, c, axis=0) for c in ends]
        self.high = [np.maximum.reduceat(self.points, c, axis=0) for c in ends]

    def sums(self, level: int) -> np.ndarray:
        return np.add.reduceat(self.points, self.cuts[level][:-1], axis=0)


def entry_tree(entries: np.ndarray) -> Tree:
    """A node per entry at the lowest level; the last entry fills up to a power of two."""
    depth = (len(entries) - 1).bit_length()
    filled = entries[np.minimum(np.arange(1 << depth), len(entries) - 1)]
    tree = Tree(filled, halved(filled, depth), depth)
    tree.order = np.minimum(tree.order, len(entries) - 1)
    return tree


def _box_distances(a: Tree, i: int, p: np.ndarray, b: Tree, j: int, e: np.ndarray):
    """Least and greatest squared distance between points of two boxes."""
    low_a, high_a, low_b, high_b = a.low[i][p], a.high[i][p], b.low[j][e], b.high[j][e]
    gap = np.maximum(np.maximum(low_b - high_a, low_a - high_b), 0)
    span = np.maximum(high_b - low_a, high_a - low_b)
    return (gap * gap).sum(1), (span * span).sum(1)


def assign(tree: Tree, entries: np.ndarray):
    """(labels, sums, counts, tried): per point the nearest entry, ties to the lower index; per
    entry the sum and number of its points; and how many exact distances were worked out.

    Entries and points are 64-bit whole numbers; a squared distance has to stay below 2^52.
    """
    n, width = tree.points.shape
    if len(entries) > MOST_ENTRIES:
        raise ValueError(f"at most {MOST_ENTRIES} entries")
    both = entry_tree(entries)
    reach = np.maximum(both.high[0][0], tree.high[0][0]) - np.minimum(both.low[0][0], tree.low[0][0])
    if sum(int(r) * int(r) for r in reach) >= MOST_DISTANCE:
        raise ValueError("components are too large for exact distances in 64 bits")
    labels = np.empty(n, np.int64)
    sums = np.zeros((len(entries), width), np.int64)
    counts = np.zeros(len(entries), np.int64)
    tried = 0
    i = j = 0
    p = e = np.zeros(1, np.int64)
    most = np.full(1, MOST_DISTANCE, np.int64)
    while len(p):
        least, greatest = _box_distances(tree, i, p, both, j, e)
        np.minimum.at(most, p, greatest)
        near = least <= most[p]
        p, e = p[near], e[near]
        if j == both.depth:
            # One entry left: the node goes to it as a whole.
            alone = np.bincount(p, minlength=len(most))[p] == 1
            whole, chosen = p[alone], both.order[e[alone]]
            np.add.at(sums, chosen, tree.sums(i)[whole])
            starts, ends = tree.cuts[i][whole], tree.cuts[i][whole + 1]
            np.add.at(counts, chosen, ends - starts)
            labels[_places(starts, ends)] = np.repeat(chosen, ends - starts)
            p, e = p[~alone], e[~alone]
            if i == tree.depth:
                starts, ends = tree.cuts[i][p], tree.cuts[i][p + 1]
                at, entry = _places(starts, ends), np.repeat(both.order[e], ends - starts)
                away = tree.points[at] - entries[entry]
                tried += len(at)
                best = np.full(n, np.iinfo(np.int64).max)
                np.minimum.at(best, at, (away * away).sum(1) * MOST_ENTRIES + entry)
                at = np.unique(at)
                labels[at] = best[at] % MOST_ENTRIES
                np.add.at(sums, labels[at], tree.points[at])
                np.add.at(counts, labels[at], 1)
                break
        if i < tree.depth:
            p, e = np.concatenate((2 * p, 2 * p + 1)), np.concatenate((e, e))
            most, i = np.repeat(most, 2), i + 1
        if j < both.depth:
            p, e = np.concatenate((p, p)), np.concatenate((2 * e, 2 * e + 1))
            j += 1
    out = np.empty(n, np.int64)
    out[tree.order] = labels
    return out, sums, counts, tried


def _places(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)
