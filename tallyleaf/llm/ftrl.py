"""Follow-the-regularised-leader (proximal) updates for sparse binary features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Ftrl:
    """Logistic regression, one adaptive rate per coordinate, L1 and L2 terms.

    ``pairs``, where given, are differences of two feature vectors (indices
    and signs) whose scores should agree; each adds the gradient of
    ``pull * (w . d) ** 2``.
    """

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias = size

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
        n = self.n[at]
        g2 = g * g
        self.z[at] += g - (np.sqrt(n + g2) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g2

    def fit(
        self,
        rows: Sequence[np.ndarray],
        scales: Sequence[float],
        labels: Sequence[int],
        epochs: int,
        pairs: Sequence[Sequence[tuple[np.ndarray, np.ndarray]]] | None = None,
        pull: float = 1.0,
        weight: tuple[float, float] = (1.0, 1.0),
    ) -> np.ndarray:
        """Runs over the rows in the given order; returns weights, the bias last."""
        for _ in range(epochs):
            for k, (row, scale, y) in enumerate(zip(rows, scales, labels, strict=True)):
                at = np.append(row, self.bias)
                x = np.full(len(at), scale)
                x[-1] = 1.0
                w = self.weights(at)
                p = 1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, float(w @ x)))))
                self.step(at, (p - y) * weight[y] * x, w)
                for idx, sign in pairs[k] if pairs else ():
                    w = self.weights(idx)
                    d = sign * scale
                    self.step(idx, 2.0 * pull * float(w @ d) * d, w)
        return self.weights(slice(None))
