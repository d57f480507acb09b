"""Logistic regression and calibration in plain numpy, for bounded training samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_sparse(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, width: int, steps: int = 120, rate: float = 0.3, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch Adam on coordinate-format rows; deterministic. A sample of one class or none gives zero weights."""
    w, n = np.zeros(width), len(y)
    share = float(np.clip((y.sum() + 0.5) / (n + 1), 1e-3, 1 - 1e-3))
    b = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return w, b
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, vals * w[cols], n) + b
        d = (sigmoid(z) - y) / n
        g = np.bincount(cols, vals * d[rows], width) + l2 * w
        gb = d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b -= step * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w, b


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, c such that sigmoid(a z + c) is calibrated: Newton steps with smoothed targets."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, p = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        q = sigmoid(x @ p)
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2)
        p = p - np.clip(np.linalg.solve(h, x.T @ (q - target) + 1e-6 * p), -1, 1)
    return float(p[0]), float(p[1])


def auc(score: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    s, rank = score[order], np.arange(1, len(y) + 1, dtype=float)
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[first, len(s)])
    rank = np.repeat(first + (size + 1) / 2, size)
    pos = y[order] > 0
    n1, n0 = pos.sum(), (~pos).sum()
    return float((rank[pos].sum() - n1 * (n1 + 1) / 2) / max(n1 * n0, 1))
