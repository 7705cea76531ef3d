"""Persistence, causality, sliced transport, principal axes and an ODE solver. Plain numpy; no scipy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def hurst(x: np.ndarray) -> float:
    """Rescaled-range exponent of step lengths over windows 4, 8, ... up to half the series, in [0, 1]; 0.5 if fewer than two windows."""
    step = np.linalg.norm(np.diff(x, axis=0), axis=1)
    sizes, values = [], []
    w = 4
    while w <= len(step) // 2:
        blocks = step[: len(step) // w * w].reshape(-1, w)
        dev = np.cumsum(blocks - blocks.mean(1, keepdims=True), 1)
        std = blocks.std(1)
        rs = np.where(std > 1e-15, (dev.max(1) - dev.min(1)) / np.maximum(std, 1e-15), 0.0).mean()
        if rs > 0:
            sizes.append(math.log(w)), values.append(math.log(rs))
        w *= 2
    return 0.5 if len(sizes) < 2 else float(np.clip(np.polyfit(sizes, values, 1)[0], 0, 1))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h / a


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F >= f)."""
    return 1.0 if f <= 0 or d1 <= 0 or d2 <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def fisher(ps: list[float]) -> float:
    """One p-value from many by Fisher's sum of logs; zeros are left out; Wilson and Hilferty's normal approximation of chi-square."""
    use = [p for p in ps if p > 0]
    if not use:
        return 1.0
    k, chi = 2 * len(use), -2 * sum(math.log(min(p, 1.0)) for p in use)
    z = ((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _rss(y: np.ndarray, x: np.ndarray) -> float:
    beta = np.linalg.solve(x.T @ x + 1e-8 * np.eye(x.shape[1]), x.T @ y)
    r = y - x @ beta
    return float(r @ r)


def lag_p(f: float, lag: int, df: int, exact: bool = True) -> float:
    """Chance of an F this large for a lag. Not exact: the beta function divided once more by its leading parameter, which makes nearly everything significant; only to reproduce figures of engines that do so."""
    if exact or f <= 0:
        return f_tail(f, lag, df)
    a, b, x = df / 2, lag / 2, df / (df + lag * f)
    return beta_inc(a, b, x) / a if x <= (a + 1) / (a + b + 2) else 1 - beta_inc(b, a, 1 - x) / b


def granger(a: np.ndarray, b: np.ndarray, lags: int = 5, exact: bool = True) -> dict:
    """Does a's past help to foretell b? The lag of the least combined p, its mean F, p, effect size and F per dimension; lag 1, F 0, p 1 if no lag tells anything or there are fewer than lags + 3 rows.

    For each lag and dimension b's own past is compared with both pasts (no intercept, a small ridge). The effect is
    the share of b's residuals, summed over dimensions, that a's past takes away.
    """
    n, dim = b.shape
    best = {"lag": 1, "f": 0.0, "p": 1.0, "effect": 0.0, "per_dimension": [0.0] * dim}
    for lag in range(1, lags + 1) if n >= lags + 3 else ():
        m, fs, ps, rest = n - lag, [], [], [0.0, 0.0]
        df = m - 2 * lag
        for k in range(dim):
            y = b[lag:, k]
            own = np.column_stack([b[lag - i : n - i, k] for i in range(1, lag + 1)])
            both = np.column_stack([own, *[a[lag - i : n - i, k] for i in range(1, lag + 1)]])
            r0, r1 = _rss(y, own), _rss(y, both)
            f = max(0.0, (r0 - r1) / lag / (r1 / df)) if df > 0 and r1 > 0 else 0.0
            fs.append(f), ps.append(lag_p(f, lag, max(df, 1), exact))
            rest = [rest[0] + r0, rest[1] + r1]
        p = fisher(ps)
        if p < best["p"]:
            best = {"lag": lag, "f": float(np.mean(fs)), "p": p, "effect": max(0.0, (rest[0] - rest[1]) / rest[0]) if rest[0] > 0 else 0.0, "per_dimension": fs}
    return best


def reading(ab: dict, ba: dict, significance: float = 0.05) -> dict:
    """Of granger's two directions: a_to_b, b_to_a, bidirectional (lag of the lesser p, the larger F and effect) or none (lag 1, F 0, p 1, effect 0)."""
    x, y = ab["p"] < significance, ba["p"] < significance
    if not x and not y:
        return {"direction": "none", "lag": 1, "f": 0.0, "p": 1.0, "effect": 0.0}
    if x and y:
        lead = ab if ab["p"] < ba["p"] else ba
        return {"direction": "bidirectional", "lag": lead["lag"], "f": max(ab["f"], ba["f"]), "p": lead["p"], "effect": max(ab["effect"], ba["effect"])}
    lead = ab if x else ba
    return {"direction": "a_to_b" if x else "b_to_a", **{k: lead[k] for k in ("lag", "f", "p", "effect")}}


def causality(a: np.ndarray, b: np.ndarray, lags: int = 5, significance: float = 0.05) -> dict:
    return reading(granger(a, b, lags), granger(b, a, lags), significance)


def align(ta: np.ndarray, a: np.ndarray, tb: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both series on the times of the longer one (a on a tie); the other linear between its points and held at its ends."""
    if len(ta) >= len(tb):
        return a, np.column_stack([np.interp(ta, tb, b[:, k]) for k in range(b.shape[1])])
    return np.column_stack([np.interp(tb, ta, a[:, k]) for k in range(a.shape[1])]), b


def directions(n: int, dim: int, seed: int = 42) -> np.ndarray:
    """Unit vectors from a 64-bit xorshift generator, the same on every run."""
    state, out = np.uint64(seed or 1), np.empty((n, dim))
    with np.errstate(over="ignore"):
        for i in range(n):
            for j in range(dim):
                for shift, left in ((13, True), (7, False), (17, True)):
                    state ^= state << np.uint64(shift) if left else state >> np.uint64(shift)
                out[i, j] = float(state) / 2**64 * 2 - 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def projected_orders(centres: np.ndarray, n: int = 50, seed: int = 42) -> list[np.ndarray]:
    """The order of the centres along each of n directions."""
    return [np.argsort(centres @ u, kind="stable") for u in directions(n, centres.shape[1], seed)]


def transport(p: np.ndarray, q: np.ndarray, orders: list[np.ndarray]) -> float:
    """Mean over orders of the transport cost between two distributions, places taken as one unit apart."""
    return float(np.mean([np.abs(np.cumsum(p[order] - q[order])).sum() for order in orders]))


def sliced_wasserstein(p: np.ndarray, q: np.ndarray, centres: np.ndarray, n: int = 50, seed: int = 42) -> float:
    """Mean over projections of the transport cost between two distributions over centres, taken as one unit apart in projected order."""
    return transport(p, q, projected_orders(centres, n, seed))


def principal_plane(x: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Coordinates on the first two principal axes by power iteration.

    An axis and its sign follow from where the iteration starts: the first one at the first centred row (the first
    unit vector if that is zero), the second one at the second centred row, made orthogonal to the first axis (if
    nothing is left, at the first unit vector of which something is). Axes are not turned afterwards.
    """
    c = x - x.mean(0)
    n, dim = c.shape
    unit = np.eye(dim)

    def axis(start: np.ndarray, against: np.ndarray | None) -> np.ndarray:
        v = start / np.linalg.norm(start)
        for _ in range(rounds):
            w = c.T @ (c @ v)
            if against is not None:
                w -= (w @ against) * against
            size = np.linalg.norm(w)
            if size < 1e-10:
                break
            w /= size
            done = np.linalg.norm(w - v) < 1e-10
            v = w
            if done:
                break
        return v

    first = axis(c[0] if n and c[0].any() else unit[0], None)
    left = lambda u: u - (u @ first) * first
    starts = [left(u) for u in ([c[1]] if n > 1 else []) + list(unit)]
    start = next((u for u in starts if np.linalg.norm(u) > 1e-10), None)
    second = np.zeros(dim) if start is None else axis(start, first)
    return c @ np.column_stack([first, second])


# fixed values: the Dormand-Prince coefficients
_C = [0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1, 1]
_A = [[], [1 / 5], [3 / 40, 9 / 40], [44 / 45, -56 / 15, 32 / 9], [19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729], [9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656], [35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84]]
_E = [71 / 57600, 0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40]


def rk45(f: Callable[[float, np.ndarray], np.ndarray], t0: float, y0: np.ndarray, t1: float, rtol: float = 1e-6, atol: float = 1e-9, most: int = 100_000) -> tuple[np.ndarray, int]:
    """y at t1 and the number of steps tried, with step control by the embedded error; raises if most steps don't suffice."""
    t, y, h, n = t0, np.asarray(y0, float), (t1 - t0) / 100, 0
    while (t1 - t) * math.copysign(1, t1 - t0) > 1e-14 * max(1, abs(t1)):
        if n >= most:
            raise RuntimeError("too many steps")
        h = math.copysign(min(abs(h), abs(t1 - t)), t1 - t0)
        k: list[np.ndarray] = []
        for c, row in zip(_C, _A):
            k.append(f(t + c * h, y + h * sum((a * x for a, x in zip(row, k)), np.zeros_like(y))))
        new = y + h * sum(a * x for a, x in zip(_A[6], k))
        err = np.sqrt(np.mean((h * sum(e * x for e, x in zip(_E, k)) / (atol + rtol * np.maximum(np.abs(y), np.abs(new)))) ** 2))
        n += 1
        if err <= 1:
            t, y = t + h, new
        h *= min(5.0, max(0.2, 0.9 * (err or 1e-10) ** -0.2))
    return y, n
