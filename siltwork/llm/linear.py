"""Sparse multinomial logistic regression: follow-the-regularised-leader (proximal) with an elastic net."""

from __future__ import annotations

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(data: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int, *, epochs: int, alpha: float, beta: float = 1.0, l1: float, l2: float, seed: int) -> np.ndarray:
    """Weights (features + 1 by classes, the last row is the bias) from (cells, values, class) rows, one row at a time
    in a seeded order. Inside, cells that no row has take no room."""
    used = np.unique(np.concatenate([np.array([features]), *(x[0] for x in data)])).astype(np.int64)
    data = [(np.searchsorted(used, at).astype(np.int32), x, y) for at, x, y in data]
    bias = len(used) - 1
    w = np.zeros((len(used), classes))
    z, n = np.zeros_like(w), np.zeros_like(w)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            at, x, y = data[i]
            at, x = np.append(at, bias), np.append(x, 1.0)
            p = softmax(x @ w[at])
            p[y] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w[at]
            n[at] = grown
            w[at] = np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(grown)) / alpha + l2))
    out = np.zeros((features + 1, classes))
    out[used] = w
    return out


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The softmax temperature, of 60 between 0.2 and 5, of least log loss; 1 without rows."""
    if not len(truth):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean())

    return float(min(np.geomspace(0.2, 5, 60), key=loss))
