"""Follow-the-regularised-leader for sparse multinomial logistic regression, with elastic-net penalties."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Penalty:
    """Step size and elastic-net strengths (l1 sparsifies, l2 shrinks)."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


class Leader:
    """Per-coordinate FTRL-proximal state for ``classes`` x ``features`` weights."""

    def __init__(self, classes: int, features: int, penalty: Penalty):
        self.z = np.zeros((classes, features))
        self.n = np.zeros((classes, features))
        self.p = penalty

    def weights(self, idx) -> np.ndarray:
        z, n = self.z[:, idx], self.n[:, idx]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.p.l1, 0.0)
        return -shrunk / ((self.p.beta + np.sqrt(n)) / self.p.alpha + self.p.l2)

    def learn(self, idx: np.ndarray, val: np.ndarray, label: int) -> None:
        """One example with distinct feature indices ``idx``."""
        w = self.weights(idx)
        err = softmax((w @ val)[None, :])[0]
        err[label] -= 1.0
        g = err[:, None] * val[None, :]
        n = self.n[:, idx]
        grown = n + g * g
        self.z[:, idx] += g - (np.sqrt(grown) - np.sqrt(n)) / self.p.alpha * w
        self.n[:, idx] = grown


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The T that minimises the negative log-likelihood of softmax(logits / T) on held-back rows."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20.0), 121))
    rows = np.arange(len(labels))

    def loss(t):
        return -np.log(np.maximum(softmax(logits / t)[rows, labels], 1e-12)).mean()

    return float(min(grid, key=loss))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, features: int, penalty: Penalty,
        epochs: int, calibrate_every: int = 5) -> tuple[np.ndarray, float]:
    """Weights (classes x features, float32) and temperature. Every ``calibrate_every``-th row is held
    back from learning and used for the temperature only; ``rows`` should come in a shuffled order."""
    learn = [r for i, r in enumerate(rows) if i % calibrate_every]
    back = [r for i, r in enumerate(rows) if not i % calibrate_every]
    model = Leader(classes, features, penalty)
    for _ in range(epochs):
        for idx, val, label in learn:
            model.learn(idx, val, label)
    w = model.weights(slice(None)).astype(np.float32)
    logits = np.array([w[:, idx] @ val for idx, val, _ in back]).reshape(len(back), classes)
    return w, temperature(logits, np.array([r[2] for r in back], dtype=int))
