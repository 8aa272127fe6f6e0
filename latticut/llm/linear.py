"""Naive Bayes support vectors: linear models on n-gram indicators scaled by class log-count ratios.

A row is the sorted distinct numbers of its features. Log-count ratios of the two classes scale the
indicators; dual coordinate descent fits a linear hinge-loss model on the scaled rows; a sigmoid
fitted on margins of rows that a fold's model has not seen turns margins into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def log_count_ratios(rows: list[np.ndarray], positive: np.ndarray, size: int, alpha: float = 1.0, least: int = 3) -> np.ndarray:
    """log of the classes' smoothed indicator rates; 0 for features in fewer rows than least."""
    count = {c: np.zeros(size) for c in (True, False)}
    for row, y in zip(rows, positive, strict=True):
        count[bool(y)][row] += 1
    up, down = count[True] + alpha, count[False] + alpha
    ratio = np.log(up / (positive.sum() + 2 * alpha)) - np.log(down / ((~positive).sum() + 2 * alpha))
    return np.where(count[True] + count[False] >= least, ratio, 0.0)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], positive: np.ndarray, size: int, cost: float = 1.0, passes: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * hinge loss, one dual variable at a time."""
    w, bias = np.zeros(size), 0.0
    y = np.where(positive, 1.0, -1.0)
    norm = np.array([float(v @ v) + 1.0 for v in values])
    # both classes weigh alike
    limit = np.where(positive, cost * len(y) / max(1, 2 * positive.sum()), cost * len(y) / max(1, 2 * (~positive).sum()))
    a = np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(a[i] - g / norm[i], 0.0), limit[i])
            if step := (new - a[i]) * y[i]:
                w[rows[i]] += step * values[i]
                bias += step
                a[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def calibrated(margins: np.ndarray, positive: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of Platt's sigmoid, by Newton steps on smoothed targets."""
    up, down = positive.sum(), (~positive).sum()
    t = np.where(positive, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margins + b)
        g = np.array([((p - t) * margins).sum() + 1e-3 * (a - 1), (p - t).sum()])
        d = p * (1 - p)
        h = np.array([[(d * margins**2).sum() + 1e-3, (d * margins).sum()], [(d * margins).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


@dataclass
class NbSvm:
    """weights holds the ratios already, so a row's margin is the sum of its features' weights."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum()) + self.bias

    def probability(self, margins):
        return sigmoid(self.slope * np.asarray(margins) + self.offset)


def _plain(rows: list[np.ndarray], positive: np.ndarray, size: int, extra: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    ratios = log_count_ratios(rows, positive, size)
    k = extra.shape[1]
    scale = np.concatenate([ratios, np.ones(k)])
    full = [np.concatenate([r, size + np.arange(k)]) if k else r for r in rows]
    values = [np.concatenate([ratios[r], e]) if k else ratios[r] for r, e in zip(rows, extra, strict=True)]
    mean = np.mean([np.sqrt(v @ v) for v in values]) or 1.0
    w, bias = dual_descent(full, [v / mean for v in values], positive, size + k)
    return (w * scale / mean)[:size], bias, w[size:] / mean


def fit(rows: list[np.ndarray], positive: np.ndarray, size: int, extra: np.ndarray | None = None, folds: int = 3) -> tuple[NbSvm, np.ndarray, np.ndarray]:
    """The model, the weights of the extra columns, and each training row's out-of-fold probability.

    With one class only, the model is that class's constant.
    """
    positive = np.asarray(positive, bool)
    extra = np.zeros((len(rows), 0)) if extra is None else extra
    share = (positive.sum() + 1) / (len(rows) + 2)
    if positive.all() or not positive.any():
        margin = float(np.log(share / (1 - share)))
        return NbSvm(np.zeros(size), margin, 1.0, 0.0), np.zeros(extra.shape[1]), np.full(len(rows), share)
    fold = np.arange(len(rows)) % folds
    margins = np.zeros(len(rows))
    for f in range(folds):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if not len(test) or positive[train].all() or not positive[train].any():
            continue
        w, bias, more = _plain([rows[i] for i in train], positive[train], size, extra[train])
        margins[test] = [w[rows[i]].sum() + bias + extra[i] @ more for i in test]
    slope, offset = calibrated(margins, positive)
    w, bias, more = _plain(rows, positive, size, extra)
    return NbSvm(w, bias, slope, offset), more, sigmoid(slope * margins + offset)
