"""Logistic regression on sparse or dense rows, fitted on the driver on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_dense(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method."""
    if len(x) == 0:
        return np.zeros(x.shape[1]), 0.0
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    keep = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(steps):
        p = sigmoid(x1 @ w)
        grad = x1.T @ (p - y) / len(x) + keep * w
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 / len(x) + np.diag(keep + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_sparse(
    rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int,
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None,
    pull: float = 1.0, ridge: float = 1e-5, steps: int = 300, rate: float = 0.1,
) -> tuple[np.ndarray, float]:
    """Adam on the whole sample. ``rows`` and ``cols`` are the ones of a 0/1 matrix (a repeated entry counts twice).

    ``pairs``: entries of two further matrices whose rows belong together, a text and its counterfactual; the squared
    difference of the two scores is penalised ``pull`` times.
    """
    n, w, b = max(1, len(y)), np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    count = int(max(pairs[0].max(initial=-1), pairs[2].max(initial=-1))) + 1 if pairs is not None else 0
    for t in range(1, steps + 1):
        p = sigmoid(np.bincount(rows, w[cols], minlength=len(y)) + b)
        g = (p - y) / n
        grad, gb = np.bincount(cols, g[rows], minlength=width) + ridge * w, g.sum()
        if count:
            p1 = sigmoid(np.bincount(pairs[0], w[pairs[1]], minlength=count) + b)
            p2 = sigmoid(np.bincount(pairs[2], w[pairs[3]], minlength=count) + b)
            d = 2 * pull * (p1 - p2) / count
            g1, g2 = d * p1 * (1 - p1), -d * p2 * (1 - p2)
            grad += np.bincount(pairs[1], g1[pairs[0]], minlength=width) + np.bincount(pairs[3], g2[pairs[2]], minlength=width)
            gb += g1.sum() + g2.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        a1, a2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a1) / (np.sqrt(v / a2) + 1e-8)
        b -= rate * (mb / a1) / (np.sqrt(vb / a2) + 1e-8)
    return w, float(b)
