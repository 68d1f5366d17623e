"""Histogram gradient-boosted trees for two classes, on numpy arrays.

Features are cut at quantiles into at most ``bins`` bins. A level of a tree sums
gradients and curvatures of the logistic loss by (node, feature, bin) and splits
every node at the best bin border. A model is three arrays (feature, border,
leaf value); all rows walk down a tree at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


@dataclass(frozen=True)
class BoostedTrees:
    """Trees of equal depth, each node an index into flat arrays.

    Node i of a tree has the children 2i+1 (value up to the border) and 2i+2;
    a node that isn't split has the border infinity, so all rows go left.
    """

    base: float
    feature: np.ndarray   # trees x inner nodes
    border: np.ndarray    # trees x inner nodes
    leaf: np.ndarray      # trees x leaves

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out, inner = np.full(len(rows), self.base), self.feature.shape[1]
        every = np.arange(len(rows))
        for feature, border, leaf in zip(self.feature, self.border, self.leaf):
            node = np.zeros(len(rows), np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (rows[every, feature[node]] > border[node])
            out += leaf[node - inner]
        return out

    def chance(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 by row."""
        return _chance(self.margin(rows))


def bin_borders(rows: np.ndarray, bins: int) -> list[np.ndarray]:
    """Distinct quantiles of each column; a value above border k is in a bin above k."""
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(column, cuts, method="lower")) for column in rows.T]


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.2,
        ridge: float = 1.0, least: float = 3.0) -> BoostedTrees:
    """Fit to rows (n x features) and labels 0 and 1. ``ridge`` is added to a
    node's curvature; a child has a curvature of at least ``least`` quarters
    of a row, ``rate`` scales each tree. Without rows the model says one half."""
    n, width = rows.shape
    positive = float(labels.sum())
    base = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    borders = bin_borders(rows, bins) if n else [np.zeros(0)] * width
    binned = np.stack([np.searchsorted(b, c, "left") for b, c in zip(borders, rows.T)], 1) if n else np.zeros((0, width), int)
    inner, leaves = 2 ** depth - 1, 2 ** depth
    feature, border, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(n, base)
    columns = np.arange(width) * bins
    for t in range(trees if 0 < positive < n else 0):
        chance = _chance(margin)
        slope, curve = labels - chance, np.maximum(chance * (1 - chance), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            cell = ((node - first)[:, None] * (width * bins) + columns + binned).ravel()
            size = count * width * bins
            g, h = (np.bincount(cell, np.repeat(x, width), size).reshape(count, width, bins) for x in (slope, curve))
            up_g, up_h = g.cumsum(2), h.cumsum(2)
            all_g, all_h = up_g[:, :, -1:], up_h[:, :, -1:]
            rest_g, rest_h = all_g - up_g, all_h - up_h
            gain = up_g ** 2 / (up_h + ridge) + rest_g ** 2 / (rest_h + ridge) - all_g ** 2 / (all_h + ridge)
            gain[(up_h < least / 4) | (rest_h < least / 4)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(borders[f]):
                    feature[t, first + k], border[t, first + k] = f, borders[f][b]
            node = 2 * node + 1 + (rows[np.arange(n), feature[t, node]] > border[t, node])
        place = node - inner
        leaf[t] = rate * np.bincount(place, slope, leaves) / (np.bincount(place, curve, leaves) + ridge)
        margin += leaf[t][place]
    return BoostedTrees(base, feature, border, leaf)
