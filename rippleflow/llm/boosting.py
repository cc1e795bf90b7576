"""Gradient-boosted trees for a yes-or-no label, on binned features."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete trees of one depth: arrays of (feature, bin) tests, then leaf values."""

    def __init__(self, cuts: list[np.ndarray], tests: np.ndarray, leaves: np.ndarray, bias: float, depth: int):
        self.cuts, self.tests, self.leaves, self.bias, self.depth = cuts, tests, leaves, bias, depth

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for tests, leaves in zip(self.tests, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = tests[at]
                at = 2 * at + 1 + (b[rows, f[:, 0]] > f[:, 1])
            out += leaves[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, n_bins: int = 32) -> Trees:
    """Newton boosting of the logistic loss, level by level, each node taking the split of most gain."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, n_bins)[1:-1])) for i in range(width)]
    model = Trees(cuts, np.zeros((0, 0, 2), np.int64), np.zeros((0, 0)), float(np.log((y.sum() + 1) / (n - y.sum() + 1))), depth)
    b = model.bins(x).astype(np.int64)
    top_bin = b.max(axis=0) if n else np.zeros(width, np.int64)
    # features of two bins are summed by one matrix product, the others bin by bin
    two, many = np.flatnonzero(top_bin == 1), np.flatnonzero(top_bin > 1)
    upper = (b[:, two] == 1).astype(np.float64)
    z = np.full(n, model.bias)
    all_tests, all_leaves = [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        tests = np.zeros((2**depth - 1, 2), np.int64)
        tests[:, 1] = n_bins
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            node = at - first
            best, choice = np.full(count, 1e-9), np.tile([0, n_bins], (count, 1))
            gt, ht = np.bincount(node, weights=g, minlength=count)[:, None], np.bincount(node, weights=h, minlength=count)[:, None]

            def take(f: np.ndarray | int, at: np.ndarray, gs: np.ndarray, hs: np.ndarray) -> None:
                """Node by node, the best of some splits: features f, bins at, sums of what stays left."""
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                top = gain.argmax(axis=1)
                won = gain[np.arange(count), top]
                better = won > best
                best[better] = won[better]
                choice[better] = np.stack([np.broadcast_to(f, gain.shape[1:])[top], np.broadcast_to(at, gain.shape[1:])[top]], axis=1)[better]

            if len(two):
                weights = np.zeros((n, 2 * count))
                weights[np.arange(n), node], weights[np.arange(n), count + node] = g, h
                sums = (upper.T @ weights).T
                take(two, 0, gt - sums[:count], ht - sums[count:])
            for f in many.tolist():
                key = node * n_bins + b[:, f]
                gs = np.bincount(key, weights=g, minlength=count * n_bins).reshape(count, n_bins).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=count * n_bins).reshape(count, n_bins).cumsum(axis=1)
                take(f, np.arange(n_bins), gs, hs)
            tests[first : first + count] = choice
            test = choice[node]
            at = 2 * at + 1 + (b[np.arange(n), test[:, 0]] > test[:, 1])
        leaf = at - (2**depth - 1)
        gs, hs = np.bincount(leaf, weights=g, minlength=2**depth), np.bincount(leaf, weights=h, minlength=2**depth)
        leaves = rate * gs / (hs + ridge)
        z += leaves[leaf]
        all_tests.append(tests)
        all_leaves.append(leaves)
    model.tests, model.leaves = np.array(all_tests), np.array(all_leaves)
    return model
