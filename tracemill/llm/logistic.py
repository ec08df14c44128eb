"""Logistic regression on the driver, for samples of a documented bound."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 60) -> np.ndarray:
    """Newton steps, halved where they would not lower the penalised loss."""
    w, parts = np.zeros(x.shape[1]), range(0, len(x), 20_000)  # products of x are made in parts: x is the largest thing here
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + 0.5 * ridge * len(y) * (w @ w)
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + ridge * len(y) * w
        hessian = sum((x[i : i + 20_000] * (p * (1 - p))[i : i + 20_000, None]).T @ x[i : i + 20_000] for i in parts) + (ridge * len(y) + 1e-9) * np.eye(len(w))
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while (then := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        if now - then < 1e-9 * max(now, 1):
            break
        w, now = w - size * step, then
    return w
