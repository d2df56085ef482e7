"""Logistic regression on sparse rows, fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(
    rows: np.ndarray,
    cols: np.ndarray,
    values: np.ndarray,
    target: np.ndarray,
    width: int,
    l1: float = 0.0,
    l2: float = 1e-4,
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
    pair_weight: float = 0.0,
    steps: int = 300,
) -> tuple[np.ndarray, float]:
    """Weights and bias for entries (row, column, value) and targets from 0 to 1, by accelerated proximal gradient.

    ``pairs`` are entries of feature differences that should not change the score: the mean square of
    ``difference . weights`` is added with ``pair_weight``.
    """
    n = max(1, len(target))
    norms = np.bincount(rows, values**2, minlength=n)
    rate = 1 / (0.25 * (np.mean(norms) * 4 + 1) + l2 + pair_weight * 2)
    rate = min(rate * 8, 2.0)
    w, b = np.zeros(width), float(np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6))) if len(target) else -10.0
    v, vb, momentum = w.copy(), b, 1.0
    last = np.inf
    for _ in range(steps):
        score = np.bincount(rows, v[cols] * values, minlength=n)[: len(target)] + vb
        p = sigmoid(score)
        gap = (p - target) / n
        grad = np.bincount(cols, gap[rows] * values, minlength=width) + l2 * v
        loss = float(np.mean(np.logaddexp(0, score) - target * score)) if len(target) else 0.0
        if pairs is not None and len(pairs[0]):
            m = pairs[0].max() + 1
            change = np.bincount(pairs[0], v[pairs[1]] * pairs[2], minlength=m)
            grad += pair_weight * 2 / m * np.bincount(pairs[1], change[pairs[0]] * pairs[2], minlength=width)
            loss += pair_weight * float(np.mean(change**2))
        if loss > last * 1.0001:  # overshot: restart the momentum with a shorter step
            rate, momentum, v, vb = rate / 2, 1.0, w.copy(), b
            last = np.inf
            continue
        last = loss
        nw = v - rate * grad
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * l1, 0)
        nb = vb - rate * gap.sum()
        nm = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, vb = nw + (momentum - 1) / nm * (nw - w), nb + (momentum - 1) / nm * (nb - b)
        w, b, momentum = nw, nb, nm
    return w, float(b)
