"""Gradient-boosted trees for a binary label, with numpy, on tables of numeric features of any size.

Trees grow by sums of gradients and curvatures over (node, feature, bin). Those are whole numbers, so that parts of a table, wherever
they lie, add up to exactly what the whole gives (``boost``); ``BoostedTrees.fit`` is the same on a table in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

import numpy as np

#: Rows whose sums are made in one go; it bounds memory, and the sums of one go fit into a double.
BLOCK = 1 << 14
#: Gradients and curvatures are whole numbers of this part of one.
_UNIT = 1 << 20
_COUNT = 34  # a row counts as this power of two, above all curvatures of a block
_NONE = 255  # a bin that no value is beyond
#: Scores are told apart by this part of one where thresholds are calibrated.
LEVELS = 1 << 12


def codes(x: np.ndarray) -> np.ndarray:
    """16 bits of each value, in the order of the values: three digits or so, so that a feature takes a bounded number of them."""
    bits = ((np.asarray(x, np.float32) + np.float32(0)).view(np.uint32) >> 16).astype(np.uint16)
    return np.where(bits >> 15 == 1, ~bits, bits | 0x8000).astype(np.uint16)


def quantiles(values: np.ndarray, counts: np.ndarray, cuts: int) -> np.ndarray:
    """Distinct quantiles of ``values`` (ascending; each ``counts`` times) below the largest one."""
    ends = np.cumsum(counts)
    found = np.unique(values[np.searchsorted(ends, np.arange(1, cuts) * int(ends[-1]) // cuts + 1)])
    return found[found < values[-1]]


class BoostedTrees:
    """Depth-limited regression trees on the logistic loss; splits are at quantiles, leaves take one Newton step."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, cuts: int = 32, least: int = 5, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.cuts, self.least, self.penalty = rounds, depth, rate, cuts, least, penalty
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.edges: list[np.ndarray] = []
        self._used = np.zeros(0, int)  # features that have cuts
        self._bins: list[tuple[np.ndarray, np.ndarray]] = []  # of each tree: which used feature a node looks at, and the cut's bin

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        c = codes(x)
        if self.begin(len(y), int(y.sum()), [quantiles(*np.unique(f, return_counts=True), self.cuts) for f in c.T] if len(y) else []):
            bins, y = self.binned(c), np.asarray(y)
            boost({0: self}, lambda trees: {0: sum(trees[0].sums(bins[:, i : i + BLOCK], y[i : i + BLOCK]) for i in range(0, len(y), BLOCK))})
        return self

    def begin(self, n: int, ones: int, edges: list[np.ndarray]) -> bool:
        """Take the table's rows, its rows of label 1 and each feature's cuts; whether there is anything to learn."""
        mean = float(np.clip(ones / n if n else 0.0, 1e-3, 1 - 1e-3))
        self.base, self.trees, self._bins, self.edges = float(np.log(mean / (1 - mean))), [], [], edges
        self._level = self.depth
        self._used = np.flatnonzero([len(e) for e in edges])
        self._starts = np.cumsum([0, *(len(edges[f]) + 1 for f in self._used)])
        return 0 < ones < n and len(self._used) > 0

    def binned(self, c: np.ndarray) -> np.ndarray:
        """(used feature, row): the bins of codes (row, feature)."""
        out = np.zeros((len(self._used), len(c)), np.uint8)
        for i, f in enumerate(self._used):
            out[i] = np.searchsorted(self.edges[f], c[:, f], "left")
        return out

    # --- growth --------------------------------------------------------------------------------------

    def sums(self, bins: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rows, gradients and curvatures of at most ``BLOCK`` rows by node of the level that grows next, feature and bin."""
        growing = self._level < self.depth
        p = 1 / (1 + np.exp(-self._raw(bins, len(self.trees) - growing)))
        g = np.rint((p - y) * _UNIT)
        h = np.rint(np.maximum(p * (1 - p), 1e-6) * _UNIT) + float(1 << _COUNT)
        width, nodes = int(self._starts[-1]), 2 ** (self._level % self.depth)
        at = bins + self._starts[:-1, None]
        if growing:
            at += self._node(bins, len(self.trees) - 1, self._level).astype(np.int64) * width
        gs, hs = (np.bincount(at.ravel(), np.broadcast_to(w, at.shape).ravel(), nodes * width).astype(np.int64) for w in (g, h))
        return np.stack([hs >> _COUNT, gs, hs & ((1 << _COUNT) - 1)])

    def split(self, sums: np.ndarray) -> None:
        """Grow the next level from its sums over all rows; a node that isn't split sends all rows to its left."""
        if self._level == self.depth:
            size = 2 ** (self.depth + 1) - 1
            self.trees.append((np.zeros(size, int), np.full(size, np.inf), np.zeros(size)))
            self._bins.append((np.zeros(size, int), np.full(size, _NONE, np.uint8)))
            self._level = 0
        feature, cut, leaf = self.trees[-1]
        first, width = 2**self._level - 1, int(self._starts[-1])
        n, g, h = sums.reshape(3, -1, width)
        g, h = g / _UNIT, h / _UNIT
        own = np.repeat(np.arange(len(self._used)), np.diff(self._starts))
        for node in range(2**self._level):
            at = first + node
            ns, gs, hs = (np.cumsum(v[node]) for v in (n, g, h))  # of the bins up to each one, within its feature
            ns, gs, hs = (v - np.r_[0, v][self._starts[own]] for v in (ns, gs, hs))
            nt, gt, ht = (v[self._starts[1] - 1] for v in (ns, gs, hs))
            gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
            gain[(ns < self.least) | (nt - ns < self.least)] = 0
            best, left, right = int(gain.argmax()), (gt, ht), (0.0, 0.0)
            if gain[best] > 1e-9:
                i, b = own[best], best - self._starts[own[best]]
                self._bins[-1][0][at], self._bins[-1][1][at] = i, b
                feature[at], cut[at] = self._used[i], self.edges[self._used[i]][b]
                left, right = (gs[best], hs[best]), (gt - gs[best], ht - hs[best])
            if self._level == self.depth - 1:
                leaf[2 * at + 1], leaf[2 * at + 2] = (-self.rate * a / (b + self.penalty) for a, b in (left, right))
        self._level += 1

    def _node(self, bins: np.ndarray, tree: int, levels: int) -> np.ndarray:
        """Each row's node among those of the tree's level."""
        (feature, cut), node = self._bins[tree], np.zeros(bins.shape[1], np.uint8)
        for level in range(levels):
            right = np.zeros(len(node), bool)
            for i in range(2**level):
                at = 2**level - 1 + i
                if cut[at] != _NONE:
                    right |= (node == i) & (bins[feature[at]] > cut[at])
            node = 2 * node + right
        return node

    def _raw(self, bins: np.ndarray, trees: int) -> np.ndarray:
        raw = np.full(bins.shape[1], self.base)
        for t in range(trees):
            raw += self.trees[t][2][2**self.depth - 1 :][self._node(bins, t, self.depth)]
        return raw

    # --- scores --------------------------------------------------------------------------------------

    def levels(self, bins: np.ndarray) -> np.ndarray:
        """The scores of binned rows, in steps of 1 / ``LEVELS``."""
        return np.floor(LEVELS / (1 + np.exp(-self._raw(bins, len(self.trees))))).astype(np.int64)

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw, c = np.full(len(x), self.base), codes(x)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (c[rows, feature[node]] > cut[node])
            raw += leaf[node]
        return 1 / (1 + np.exp(-raw))


def boost(trees: Mapping[Any, BoostedTrees], sums: Callable[[Mapping[Any, BoostedTrees]], Mapping[Any, np.ndarray]]) -> None:
    """Grow trees that have begun and are of one shape, all at once; ``sums`` adds up each one's ``sums`` over its table, once a level."""
    for _ in range(max((t.rounds * t.depth for t in trees.values()), default=0)):
        for key, s in sums(trees).items():
            trees[key].split(s)


def calibrated_threshold(p: np.ndarray, y: np.ndarray, precision: float, floor: float = 0.5, n: np.ndarray | None = None) -> float:
    """The lowest threshold, at least ``floor``, from which on ``precision`` is held on (p, y), each ``n`` times; above 1 if none does."""
    if not len(p):
        return 1.1
    order = np.argsort(-p, kind="stable")
    n = np.ones(len(p), np.int64) if n is None else n[order]
    right = np.cumsum(y[order] * n) / np.cumsum(n)
    last = np.r_[p[order][1:] != p[order][:-1], True]  # equal scores stand or fall together
    ok = np.flatnonzero((right >= precision) & last & (p[order] >= floor))
    return float(p[order][ok[-1]]) if len(ok) else 1.1
