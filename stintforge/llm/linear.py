"""Logistic regression on a bounded sample, on the driver: Newton steps with a ridge."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None, steps: int = 12, offset: np.ndarray | float = 0.0) -> np.ndarray:
    """Coefficients, the intercept last; ``y`` may be a probability.  The intercept is not penalised; log odds ``offset`` are given."""
    rows = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(rows.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(rows.shape[1])
    if np.ndim(offset) == 0:
        beta[-1] = np.log((weight @ y + 0.5) / (weight @ (1 - y) + 0.5))

    def loss(b: np.ndarray) -> float:
        z = rows @ b + offset
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * penalty @ b**2)

    now = loss(beta)
    for _ in range(steps):
        p = sigmoid(rows @ beta + offset)
        gradient = rows.T @ (weight * (p - y)) + penalty * beta
        hessian = (rows * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ rows + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        scale = 1.0
        while scale > 1e-3 and loss(beta - scale * move) > now:
            scale /= 2
        beta = beta - scale * move
        before, now = now, loss(beta)
        if before - now < 1e-7 * max(1.0, abs(now)):
            break
    return beta


def apply(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ beta[:-1] + beta[-1]


def calibrate(odds: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Slope and intercept that fit log odds to labels; the fewer the labels, the nearer to slope 1 and intercept 0."""
    shift = np.concatenate([[0.0, 0.0], odds])  # two weak rows, of either label, hold the intercept
    labels, weight = np.concatenate([[0.0, 1.0], y]), np.concatenate([[0.5, 0.5], np.ones(len(y))])
    beta = logistic(shift[:, None], labels, ridge=ridge, weight=weight, offset=shift)
    return np.array([1 + beta[0], beta[1]])
