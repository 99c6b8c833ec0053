"""Linear-chain conditional random fields in numpy.

Each position of a chain has a fixed number of feature ids; its score for a label is the sum of
their weights. Chains lie one behind another in flat arrays, cut by offsets, and are worked on
side by side: step t handles position t of every chain that is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


def _steps(offs: np.ndarray) -> Iterator[np.ndarray]:
    """Positions t = 0, 1, ... of the chains, longest chain first (so a step's chains begin the last step's)."""
    length = np.diff(offs)
    order = np.argsort(-length, kind="stable")
    first, length = offs[:-1][order], length[order]
    for t in range(int(length[0]) if len(length) else 0):
        yield first[: np.searchsorted(-length, -t, "left")] + t


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


@dataclass
class Crf:
    """weights: by feature id and label; moves: from label, to label; start: by label."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), self.weights.shape[1]))
        for k in range(features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def forward_backward(self, emit: np.ndarray, offs: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Marginals by position, summed marginals of moves and of starts, log-likelihood normaliser."""
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        steps = list(_steps(offs))
        for t, at in enumerate(steps):
            alpha[at] = emit[at] + (self.start if not t else _logsum(alpha[at - 1][:, :, None] + self.moves, 1))
        moved = np.zeros_like(self.moves)
        for t in range(len(steps) - 1, 0, -1):
            at = steps[t]
            ahead = emit[at] + beta[at]
            beta[at - 1] = _logsum(self.moves + ahead[:, None, :], 2)
            if pairs:
                x = alpha[at - 1][:, :, None] + self.moves + ahead[:, None, :]
                total = _logsum(x.reshape(len(at), -1), 1)
                moved += np.exp(x - total[:, None, None]).sum(axis=0)
        both = alpha + beta
        norm = _logsum(both, 1)
        marginals = np.exp(both - norm[:, None])
        heads = offs[:-1][np.diff(offs) > 0]
        return marginals, moved, marginals[heads].sum(axis=0), float(norm[heads].sum())

    def viterbi(self, emit: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The best label of each position."""
        best, back = np.empty_like(emit), np.zeros(emit.shape, np.int64)
        steps = list(_steps(offs))
        for t, at in enumerate(steps):
            if not t:
                best[at] = emit[at] + self.start
                continue
            x = best[at - 1][:, :, None] + self.moves
            back[at] = x.argmax(axis=1)
            best[at] = emit[at] + x.max(axis=1)
        out = np.zeros(len(emit), np.int64)
        ends = (offs[1:] - 1)[np.diff(offs) > 0]
        out[ends] = best[ends].argmax(axis=1)
        for at in reversed(steps[1:]):
            out[at - 1] = back[at, out[at]]
        return out


def train(features: np.ndarray, labels: np.ndarray, offs: np.ndarray, size: int, kinds: int, rounds: int = 60, rate: float = 0.15, l2: float = 1e-3, fixed: np.ndarray | None = None) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adam over all chains. fixed: moves that are ruled out (-inf) or free (0)."""
    crf = Crf(np.zeros((size, kinds)), np.zeros((kinds, kinds)), np.zeros(kinds))
    ruled = np.zeros((kinds, kinds)) if fixed is None else np.where(np.isinf(fixed), -1e4, 0.0)
    n = max(1, len(labels))
    heads = offs[:-1][np.diff(offs) > 0]
    inner = np.ones(len(labels), bool)
    inner[heads] = False
    later = np.flatnonzero(inner)
    want_moves = np.zeros((kinds, kinds))
    np.add.at(want_moves, (labels[later - 1], labels[later]), 1)
    want_start = np.bincount(labels[heads], minlength=kinds).astype(float)
    flat = features.T.ravel()
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (crf.weights, crf.moves, crf.start)]
    for step in range(1, rounds + 1):
        crf.moves += ruled
        marginals, moved, begun, _ = crf.forward_backward(crf.scores(features), offs, pairs=True)
        crf.moves -= ruled
        off = marginals.copy()
        off[np.arange(n), labels] -= 1
        push = np.stack([np.bincount(flat, np.tile(off[:, k], features.shape[1]), minlength=size) for k in range(kinds)], axis=1)
        for x, grad, (m, v) in zip((crf.weights, crf.moves, crf.start), (push / n, (moved - want_moves) / n, (begun - want_start) / n), state, strict=True):
            grad = grad + l2 * x
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    crf.moves += ruled
    return crf
