"""Gradient-boosted trees of equal depth on quantile bins, under logistic loss, in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """By tree: the feature and the bound of each node, the values of the leaves. A value above the bound goes right."""

    base: float
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, flat = np.full(len(x), self.base), np.ascontiguousarray(x).ravel()
        first = np.arange(len(x)) * x.shape[1]
        for feature, bound, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (flat[first + feature[node]] > bound[node])
            out += value[node - (2**self.depth - 1)]
        return out


def grow(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int, rate: float, leaf: float) -> Trees:
    """Trees for rows x with labels y (0 or 1); a leaf holds ``leaf`` / 4 of the summed curvature at least."""
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Trees(20.0 if share else -20.0, depth)
    model = Trees(math.log(share / (1 - share)), depth)
    bounds = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    cells = np.stack([np.searchsorted(b, column) for b, column in zip(bounds, x.T, strict=True)], axis=1)
    z = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, bound, node = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf), np.zeros(len(y), int)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for f, edges in enumerate(bounds):
                if not len(edges):
                    continue
                at = (node - first) * (bins + 1) + cells[:, f]
                gs, hs = (np.bincount(at, v, width * (bins + 1)).reshape(width, -1).cumsum(axis=1) for v in (g, h))
                right_g, right_h = gs[:, -1:] - gs, hs[:, -1:] - hs
                gain = gs**2 / (hs + 1) + right_g**2 / (right_h + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                gain[(hs < leaf / 4) | (right_h < leaf / 4)] = 0
                cut = gain[:, : len(edges)].argmax(axis=1)
                top = gain[np.arange(width), cut]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = f
                bound[first : first + width][better] = edges[cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > bound[node])
        end = node - (2**depth - 1)
        value = rate * np.bincount(end, g, 2**depth) / (np.bincount(end, h, 2**depth) + 1)
        model.trees.append((feature, bound, value))
        z += value[end]
    return model
