"""Change points of one trajectory: optimal segmentation with pruning, and an online detector. Plain numpy."""

from __future__ import annotations

import math

import numpy as np


def segments(x: np.ndarray, penalty: float | None = None, least: int = 2) -> list[int]:
    """Begins of new segments that minimise squared deviation from segment means plus a penalty per segment.

    The penalty is dims * ln(n) / 2 by default. Candidates that can't win any more are dropped; if more than half
    of all places remain, only the best quarter is kept, as the compared engine does. Under four points: none.
    """
    n, dim = x.shape
    if n < max(4, 2 * least):
        return []
    beta = dim * math.log(n) / 2 if penalty is None else penalty
    sums, squares = np.vstack([np.zeros(dim), np.cumsum(x, 0)]), np.concatenate([[0.0], np.cumsum((x * x).sum(1))])
    best, origin = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -beta
    open_ = np.array([0])
    for t in range(least, n + 1):
        size = t - open_
        diff = sums[t] - sums[open_]
        cost = squares[t] - squares[open_] - (diff * diff).sum(1) / size
        cost = np.maximum(cost, 0.0)
        usable = size >= least
        total = np.where(usable, best[open_] + cost + beta, np.inf)
        i = int(np.argmin(total))
        best[t], origin[t] = (total[i], open_[i]) if np.isfinite(total[i]) else (np.inf, 0)
        open_ = np.append(open_[~usable | (best[open_] + cost <= best[t] + beta)], t)
        if len(open_) > n // 2:
            open_ = open_[np.argsort(best[open_], kind="stable")[: n // 4]]
    cuts, at = [], n
    while at > 0:
        at = int(origin[at])
        if at:
            cuts.append(at)
    return cuts[::-1]


def severity(x: np.ndarray, at: int, ahead: int = 10) -> tuple[float, np.ndarray]:
    """1 - exp(-size of the drift) and the drift: mean of the next points less the mean of everything before."""
    drift = x[at : at + ahead].mean(0) - x[:at].mean(0)
    return float(1 - math.exp(-np.linalg.norm(drift))), drift


class Online:
    """Exponentially weighted detector; its state is five plain values, so a stream can store it."""

    def __init__(self, rate: float = 0.05, threshold: float = 3.0, wait: int = 5):
        self.rate, self.threshold, self.wait = rate, threshold, wait
        self.mean: np.ndarray | None = None
        self.var: np.ndarray | None = None
        self.anchor: np.ndarray | None = None
        self.count = self.since = 0

    def observe(self, v: np.ndarray) -> tuple[float, np.ndarray] | None:
        """Severity, 1 - exp(-size of the drift), and drift of the running mean since the last hit, where the new vector is off by more than threshold deviations (taken before the update)."""
        if self.mean is None or self.var is None or self.anchor is None:
            self.mean, self.var, self.anchor = v.copy(), np.ones_like(v), v.copy()
            self.count = self.since = 1
            return None
        z2 = (v - self.mean) ** 2 / np.maximum(self.var, 1e-10)
        score = math.sqrt(float(z2.mean()))
        self.count += 1
        self.since += 1
        delta = v - self.mean
        self.mean = self.mean + self.rate * delta
        self.var = (1 - self.rate) * (self.var + self.rate * delta * delta)
        if self.count > self.wait and self.since >= self.wait and score > self.threshold:
            drift = self.mean - self.anchor
            self.anchor, self.since = self.mean.copy(), 0
            return 1 - math.exp(-float(np.linalg.norm(drift))), drift
        return None


def soft_changes(x: np.ndarray, z: float = 3.0, cooldown: int = 5) -> int:
    """Steps longer than z deviations above the mean step, not counting the next cooldown steps after a hit."""
    if len(x) < 3:
        return 0
    step = np.linalg.norm(np.diff(x, axis=0), axis=1)
    odd = (step - step.mean()) / max(step.std(), 1e-10) > z
    hits, i = 0, 0
    while i < len(odd):
        if odd[i]:
            hits, i = hits + 1, i + cooldown
        i += 1
    return hits
