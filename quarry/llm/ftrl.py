"""Follow-the-regularised-leader (proximal) with elastic-net penalties on sparse rows, for training on the driver.

The rows are a bounded sample (its size is a parameter of each operator); the models are applied on executors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Rows = list[tuple[np.ndarray, np.ndarray]]


class Leader:
    """Per-coordinate state of ``outputs`` weight vectors over ``size`` features."""

    def __init__(self, size: int, outputs: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z = np.zeros((size, outputs))
        self.n = np.zeros((size, outputs))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, at: np.ndarray, grad: np.ndarray, w: np.ndarray) -> None:
        """``at`` holds distinct features."""
        n = self.n[at]
        new = n + grad * grad
        self.z[at] += grad - (np.sqrt(new) - np.sqrt(n)) / self.alpha * w
        self.n[at] = new


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def multinomial(rows: Rows, label: np.ndarray, size: int, classes: int, epochs: int = 4, seed: int = 5, **penalty: float) -> np.ndarray:
    """Weights (size + 1, classes) of a softmax regression; the last feature is the constant one."""
    lead = Leader(size + 1, classes, **penalty)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, size), np.append(x, 1.0)
            w = lead.weights(at)
            p = softmax(x @ w)
            p[label[i]] -= 1
            lead.step(at, x[:, None] * p[None, :], w)
    return lead.weights()


def ordinal(rows: Rows, grade: np.ndarray, size: int, grades: int, epochs: int = 6, seed: int = 5, **penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of a cumulative-link model: P(y <= k) = sigmoid(threshold[k] - w.x), ``grades`` - 1
    ascending thresholds over the same weights."""
    lead = Leader(size, 1, **penalty)
    share = np.array([np.clip((grade <= k).mean() if len(grade) else 0.5, 0.02, 0.98) for k in range(grades - 1)])
    apart = 0.1 * np.arange(grades - 1)  # thresholds keep this distance
    theta = np.maximum.accumulate(np.log(share / (1 - share)) - apart) + apart
    rng = np.random.default_rng(seed)
    t = 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = lead.weights(at)
            c = sigmoid(theta - (x @ w)[0])
            full = np.concatenate([[0.0], c, [1.0]])
            y = grade[i]
            p = max(full[y + 1] - full[y], 0.02)
            slope = np.concatenate([[0.0], c * (1 - c), [0.0]])
            # loss -log(c_y - c_(y-1)); by the score w.x, and by each of the two thresholds around y
            lead.step(at, (x * (slope[y + 1] - slope[y]) / p)[:, None], w)
            t += 1
            rate = 0.2 / np.sqrt(1 + t / 100)
            if y < grades - 1:
                theta[y] += rate * slope[y + 1] / p
            if y > 0:
                theta[y - 1] -= rate * slope[y] / p
            theta = np.maximum.accumulate(theta - apart) + apart
    return lead.weights()[:, 0], theta


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients of a ridge logistic regression on a few dense columns (Newton steps)."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + d
        if np.abs(d).max() < 1e-8:
            break
    return w


def best_temperature(loss: Callable[[float], float]) -> float:
    """The temperature between 1/20 and 20 with the least loss (golden section on its logarithm)."""
    lo, hi, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = loss(np.exp(a)), loss(np.exp(b))
    for _ in range(40):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = loss(np.exp(a))
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = loss(np.exp(b))
    return float(np.exp((lo + hi) / 2))
