"""Signature trees over token sets: OR-combined bitmaps and size ranges, joined by dual traversal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

FANOUT = 8
#: A bitmap has about so many bits per token of the largest set, within these bounds.
BITS_PER_TOKEN, LEAST_BITS, MOST_BITS = 8, 512, 1 << 15


def bitmap_bits(largest: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_TOKEN * max(1, largest) - 1).bit_length()))


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    one = np.zeros(bits, dtype=bool)
    one[tokens & (bits - 1)] = True
    return np.packbits(one, bitorder="little").view(np.uint64)


@dataclass
class SignatureTree:
    """Layers from the sets up to the root: bitmaps, least and greatest sizes, and excess.

    The excess of a set is its size minus the bits it sets: so many of its tokens share a bit with another.
    A node's is the greatest of its members'.
    """

    order: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], bits: int) -> SignatureTree:
        """Sets with the same least tokens, such as near copies, become neighbours."""
        order = np.array(sorted(range(len(sets)), key=lambda i: (tuple(sets[i][:2].tolist()), len(sets[i]))), dtype=np.int64)
        words = np.stack([bitmap(sets[i], bits) for i in order])
        sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
        return cls.build(order, words, sizes, sizes - np.bitwise_count(words).sum(axis=1, dtype=np.int64))

    @classmethod
    def build(cls, order: np.ndarray, words: np.ndarray, sizes: np.ndarray, excess: np.ndarray) -> SignatureTree:
        """From bitmaps, sizes and excesses that stand in ``order``."""
        layers = [(words, sizes, sizes, excess)]
        while len(layers[-1][1]) > 1:
            below = layers[-1]
            cuts = np.arange(0, len(below[1]), FANOUT)
            layers.append(
                (
                    np.bitwise_or.reduceat(below[0], cuts, axis=0),
                    np.minimum.reduceat(below[1], cuts),
                    np.maximum.reduceat(below[2], cuts),
                    np.maximum.reduceat(below[3], cuts),
                )
            )
        return cls(order, layers)


class Groups:
    """Union-find over local set numbers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def possible(one, other, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """For each pair of nodes, whether some pair of their sets may still be similar enough.

    Two sets share at most as many tokens as both bitmaps have bits in common, plus the lesser excess; they
    must share percent / (100 + percent) of both sizes together.
    """
    common = np.bitwise_count(one[0][x] & other[0][y]).sum(axis=-1, dtype=np.int64) + np.minimum(one[3][x], other[3][y])
    enough = (100 + percent) * common >= percent * (one[1][x] + other[1][y])
    return enough & (100 * one[2][x] >= percent * other[1][y]) & (100 * other[2][y] >= percent * one[1][x])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def traverse(one: SignatureTree, other: SignatureTree | None, percent: int, linked: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links connect: within a tree, or between two; numbers of ``other`` follow those of ``one``.

    The traversal goes down both trees at once and leaves pairs of nodes that can't hold a link. Of the pairs
    of sets that remain, those already connected need no comparison; ``linked`` compares the others. Without it
    every pair that the signatures leave possible counts as a link.
    """
    within, other = other is None, one if other is None else other
    shift = 0 if within else len(one.order)
    groups, links = Groups(len(one.order) + (0 if within else len(other.order))), []
    depth = max(len(one.layers), len(other.layers)) - 1
    settled: set[tuple[int, int, int]] = set()

    def group_of(tree: SignatureTree, shift: int, d: int, k: int) -> int:
        """The group of all sets below a node, or -1 while they are in several; what is in one group stays so."""
        root = groups.find(int(tree.order[k * FANOUT**d]) + shift)
        if d == 0 or (shift, d, k) in settled:
            return root
        last = min((k + 1) * FANOUT, len(tree.layers[d - 1][1]))
        if any(group_of(tree, shift, d - 1, m) != root for m in range(k * FANOUT, last)):
            return -1
        settled.add((shift, d, k))
        return root

    layer = lambda tree, d: tree.layers[min(d, len(tree.layers) - 1)]
    stack = [(depth, np.array([0]), np.array([0]))]
    while stack:
        d, x, y = stack.pop()
        ok = possible(layer(one, d), layer(other, d), x, y, percent)
        x, y = x[ok], y[ok]
        if d == 0:
            for i, j in zip(one.order[x].tolist(), (other.order[y] + shift).tolist(), strict=True):
                if i != j and groups.find(i) != groups.find(j) and (linked is None or linked(i, j)):
                    groups.union(i, j)
                    links.append((i, j))
            continue
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            root = group_of(one, 0, min(d, len(one.layers) - 1), i)
            if root >= 0 and root == group_of(other, shift, min(d, len(other.layers) - 1), j):
                continue  # all sets below both are connected already
            below = [
                np.arange(k * FANOUT, min((k + 1) * FANOUT, len(tree.layers[d - 1][1]))) if d < len(tree.layers) else np.array([k])
                for tree, k in ((one, i), (other, j))
            ]
            p, q = np.repeat(below[0], len(below[1])), np.tile(below[1], len(below[0]))
            if within:
                upper = p <= q
                p, q = p[upper], q[upper]
            stack.append((d - 1, p, q))
    return links


def forest(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Exact links that connect what all links connect: pairs within ``left``, or between ``left`` and ``right``."""
    sets = left + (right or [])
    bits = bitmap_bits(max(map(len, sets)))
    one = SignatureTree.of_sets(left, bits)
    other = None if right is None else SignatureTree.of_sets(right, bits)
    return traverse(one, other, percent, lambda i, j: similar(sets[i], sets[j], percent))
