"""A linear-chain conditional random field over many short sequences at once.

Sequences lie one after the other in flat arrays; ``lengths`` are their sizes. All of them advance together, position by
position, so the loops run over the longest sequence and not over the sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from wayline.llm.optimise import minimise


@dataclass
class CRF:
    """Weights (features x labels, with a last row for the constant), transitions (from x to) and first-label scores."""

    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_labels: int = 2, l2: float = 1.0, steps: int = 80) -> CRF:
        """Penalised maximum likelihood of ``labels``; without rows all weights are zero."""
        f, k = x.shape[1] + 1, n_labels
        sizes = np.cumsum([f * k, k * k, k])
        if not len(x):
            return cls(np.zeros((f, k)), np.zeros((k, k)), np.zeros(k))
        order = _Order(lengths)
        gold = np.eye(k)[labels]
        with_one = np.concatenate([x, np.ones((len(x), 1))], 1)
        pairs = np.zeros((k, k))
        np.add.at(pairs, (labels[order.before], labels[order.after]), 1)
        starts = gold[order.starts].sum(0)

        def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
            model = cls(*(a.reshape(s) for a, s in zip(np.split(p, sizes[:2]), ((f, k), (k, k), (k,)), strict=True)))
            emit = with_one @ model.weights
            node, joint, log_z = model._marginals(emit, order)
            score = (emit * gold).sum() + (pairs * model.transitions).sum() + (starts * model.first).sum()
            slope = np.concatenate([(with_one.T @ (node - gold)).ravel(), (joint - pairs).ravel(), node[order.starts].sum(0) - starts])
            return (log_z - score + l2 / 2 * (p @ p)) / len(x), (slope + l2 * p) / len(x)

        p = minimise(loss, np.zeros(sizes[-1]), steps)
        return cls(*(a.reshape(s) for a, s in zip(np.split(p, sizes[:2]), ((f, k), (k, k), (k,)), strict=True)))

    def _emit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def _marginals(self, emit: np.ndarray, order: _Order) -> tuple[np.ndarray, np.ndarray, float]:
        top = emit.max(1, keepdims=True)
        e, t = np.exp(emit - top), np.exp(self.transitions)
        ahead, scale = np.empty_like(e), np.empty(len(e))
        for step, at in enumerate(order.steps()):
            a = e[at] * (np.exp(self.first) if step == 0 else ahead[at - 1] @ t)
            scale[at] = a.sum(1)
            ahead[at] = a / scale[at, None]
        behind = np.ones_like(e)
        for at in order.steps(back=True):
            behind[at - 1] = ((e[at] * behind[at]) @ t.T) / scale[at, None]
        node = ahead * behind
        node /= node.sum(1, keepdims=True)
        joint = t * (ahead[order.before].T @ (e[order.after] * behind[order.after] / scale[order.after, None]))
        return node, joint, float(np.log(scale).sum() + top.sum())

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each position's probability of each label, by forward-backward."""
        return self.marginals_of(self._emit(x), lengths)

    def marginals_of(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``marginals`` from the positions' label scores."""
        return self._marginals(emit, _Order(lengths))[0]

    def viterbi(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The most likely labels of each sequence; ties go to the lower label."""
        emit, order = self._emit(x), _Order(lengths)
        best, came = np.empty_like(emit), np.zeros(emit.shape, np.int64)
        for step, at in enumerate(order.steps()):
            if step == 0:
                best[at] = emit[at] + self.first
                continue
            ways = best[at - 1][:, :, None] + self.transitions
            came[at] = ways.argmax(1)
            best[at] = emit[at] + ways.max(1)
        out = np.zeros(len(emit), np.int64)
        out[order.ends] = best[order.ends].argmax(1)
        for at in order.steps(back=True):
            out[at - 1] = came[at, out[at]]
        return out


class _Order:
    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        some = lengths > 0
        self.starts, sizes = starts[some], lengths[some]
        self.ends = self.starts + sizes - 1
        by_size = np.argsort(-sizes, kind="stable")
        self.sorted, self.sizes = self.starts[by_size], sizes[by_size]
        total = int(lengths.sum())
        inner = np.ones(total, bool)
        inner[self.starts] = False
        self.after = np.flatnonzero(inner)
        self.before = self.after - 1

    def steps(self, back: bool = False):
        """Flat places of position 0, 1, ... of all sequences that reach it; backwards down to position 1."""
        longest = int(self.sizes[0]) if len(self.sizes) else 0
        for step in range(longest - 1, 0, -1) if back else range(longest):
            yield self.sorted[: np.searchsorted(-self.sizes, -step, side="left")] + step
