"""Hashed sparse rows and linear models fitted by dual coordinate descent."""

from __future__ import annotations

import numpy as np


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, weight: np.ndarray, dim: int, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Hinge-loss linear model by dual coordinate descent over sparse rows.

    rows and values: indexes and values of each row; y: +1 or -1; weight: the upper bound of each dual
    variable (cost times the row's weight). Returns dim + 1 weights, the last of them the bias.
    """
    w, alpha, order = np.zeros(dim + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            idx, val = rows[i], values[i]
            g = y[i] * (float(w[idx] @ val) + w[dim]) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), weight[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[idx] += step * val
                w[dim] += step
                moved, alpha[i] = max(moved, abs(new - alpha[i])), new
        if moved < 1e-4:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a * margin + b))), by Newton's method on smoothed targets."""
    pos, neg = float(weight[y > 0].sum()), float(weight[y <= 0].sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        d, s = weight * (target - p), weight * p * (1 - p)
        h11, h12, h22 = float((s * margin * margin).sum()) + 1e-6, float((s * margin).sum()), float(s.sum()) + 1e-6
        g1, g2 = float((d * margin).sum()), float(d.sum())
        det = h11 * h22 - h12 * h12
        if det <= 0:
            break
        da, db = (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det
        a, b = a + np.clip(da, -5, 5), b + np.clip(db, -5, 5)
        if abs(da) + abs(db) < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)
