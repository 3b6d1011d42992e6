"""Gradient-boosted trees with logistic loss over tables of forms: binned features with a mark and a count.

Counts of gradients are sums of whole numbers (in units of UNIT), so they are the same however rows are dealt into tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

UNIT = 2.0**-20  # of gradients and curvatures; sums stay exact in doubles up to 2^33 rows


@dataclass
class Boosted:
    """Complete trees of one depth: per inner node a feature and a cut (go right above it), per leaf a value."""

    base: float = 0.0
    depth: int = 3
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.25, l2: float = 1.0, cuts: int = 32) -> Boosted:
        """Fit on rows in memory, cuts by quantiles."""
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1)[:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        n = np.ones(len(y))
        grown = cls.grow(lambda m, f, c, level: m.sums(binned, y, n, f, c, level, cuts + 1), len(edges), cuts + 1, len(y), float(y.sum()), rounds, depth, rate, l2)
        return grown.named(edges)

    @classmethod
    def grow(cls, sums: Callable[[Boosted, np.ndarray, np.ndarray, int], np.ndarray], features: int, bins: int, rows: float, marked: float, rounds: int = 60, depth: int = 3, rate: float = 0.25, l2: float = 1.0) -> Boosted:
        """Trees over bins from histograms alone: ``sums(model, features, cuts, level)`` is called once for each level of each tree."""
        share = min(max(marked / rows if rows else 0.5, 1e-3), 1 - 1e-3)
        model = cls(float(np.log(share / (1 - share))), depth)
        for _ in range(rounds if 0 < marked < rows else 0):
            chosen, limits, values = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(2**depth)
            for level in range(depth):
                g, h = model_sums = sums(model, chosen, limits, level)
                gl, hl = np.cumsum(model_sums, axis=-1)[..., :-1]
                g, h = g.sum(-1)[:, :1, None], h.sum(-1)[:, :1, None]
                gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                for k in range(2**level):
                    j, c = np.unravel_index(int(gain[k].argmax()), (features, bins - 1))
                    node, split = 2**level - 1 + k, gain[k, j, c] > 1e-6
                    if split:
                        chosen[node], limits[node] = j, c
                    if level == depth - 1:
                        sides = ((gl[k, j, c], hl[k, j, c]), (g[k, 0, 0] - gl[k, j, c], h[k, 0, 0] - hl[k, j, c])) if split else ((g[k, 0, 0], h[k, 0, 0]), (0.0, 0.0))
                        values[2 * k : 2 * k + 2] = [-rate * a / (b + l2) for a, b in sides]
            model.trees.append((chosen, limits, values))
        return model

    def sums(self, binned: np.ndarray, y: np.ndarray, n: np.ndarray, features: np.ndarray, limits: np.ndarray, level: int, bins: int) -> np.ndarray:
        """Gradients and curvatures of these rows by node of a level, feature and bin."""
        p = 1 / (1 + np.exp(-self.score(binned)))
        at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(level):
            at = 2 * at + 1 + (binned[rows, features[at]] > limits[at])
        at -= 2**level - 1
        parts = [np.rint(v / UNIT) * n * UNIT for v in (p - y, np.maximum(p * (1 - p), 1e-6))]
        out = np.zeros((2, 2**level, binned.shape[1], bins))
        for i, v in enumerate(parts):
            for j in range(binned.shape[1]):
                out[i, :, j] = np.bincount(at * bins + binned[:, j], v, 2**level * bins).reshape(-1, bins)
        return out

    def named(self, edges: list[np.ndarray]) -> Boosted:
        """The same trees over the features' own values, whose bins these edges cut."""
        value = lambda j, c: edges[j][int(c)] if c < len(edges[j]) else np.inf
        return Boosted(self.base, self.depth, [(f, np.array([value(j, c) for j, c in zip(f, cut)]), v) for f, cut, v in self.trees])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for features, limits, values in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, features[at]] > limits[at])
            out += values[at - (2**self.depth - 1)]
        return out
