"""Gradient-boosted regression trees for a binary label, over binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: a feature and a bin to go right from, for each inner node, and a value for each leaf."""

    cuts: tuple[np.ndarray, ...]
    start: float
    feature: np.ndarray
    above: np.ndarray
    value: np.ndarray

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, rows[:, k], side="left") for k, c in enumerate(self.cuts)], axis=1)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        bins, at = self.bins(rows), np.arange(len(rows))
        total = np.full(len(rows), self.start)
        for feature, above, value in zip(self.feature, self.above, self.value):
            node = np.zeros(len(rows), np.int64)
            for _ in range(int(np.log2(len(value)))):
                node = 2 * node + 1 + (bins[at, feature[node]] > above[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(rows: np.ndarray, label: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; each split has the largest gain over all features and bins of its node."""
    cuts = tuple(np.unique(np.quantile(rows[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(rows.shape[1]))
    shape = Trees(cuts, 0.0, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)))
    bins, n = shape.bins(rows), rows.shape[1]
    flat = bins + np.arange(n) * BINS
    mean = np.clip(label.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(mean / (1 - mean)))
    total, at = np.full(len(rows), start), np.arange(len(rows))
    features, aboves, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        grad, weight = p - label, p * (1 - p)
        feature, above = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.int64)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            where = ((node - first)[:, None] * (n * BINS) + flat).reshape(-1)
            g = np.bincount(where, np.repeat(grad, n), width * n * BINS).reshape(width, n, BINS).cumsum(2)
            h = np.bincount(where, np.repeat(weight, n), width * n * BINS).reshape(width, n, BINS).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < 1e-3) | (all_h - h < 1e-3)] = 0
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1).max(1) > 1e-9
            feature[first : first + width] = np.where(good, best // BINS, 0)
            above[first : first + width] = np.where(good, best % BINS, BINS)
            node = 2 * node + 1 + (bins[at, feature[node]] > above[node])
        leaf = node - len(feature)
        value = -rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, weight, 2**depth) + ridge)
        total = total + value[leaf]
        features.append(feature)
        aboves.append(above)
        values.append(value)
    return Trees(cuts, start, np.array(features), np.array(aboves), np.array(values))
