"""Motifs, discords, signatures, curve distances and topology of one trajectory. Plain numpy."""

from __future__ import annotations

import math

import numpy as np


def matrix_profile(x: np.ndarray, w: int, exclusion: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Per window its distance (root of the mean squared distance of its rows) to the nearest window outside the exclusion zone, and where that is (-1: none).

    Sums of squared row distances slide along diagonals, so a pair of windows costs one step.
    """
    n = len(x) - w + 1
    if len(x) < 2 * w or w < 1:
        return np.zeros(0), np.zeros(0, int)
    zone = max(1, math.ceil(w * exclusion))
    profile, place = np.full(n, np.inf), np.full(n, -1)
    for lag in range(zone, n):
        d = ((x[lag:] - x[: len(x) - lag]) ** 2).sum(1)
        c = np.concatenate([[0.0], np.cumsum(d)])
        dist = np.sqrt(np.maximum(c[w:] - c[:-w], 0) / w)
        i = np.arange(len(dist))
        low = dist < profile[i]
        profile[i[low]], place[i[low]] = dist[low], i[low] + lag
        low = dist < profile[i + lag]
        profile[i[low] + lag], place[i[low] + lag] = dist[low], i[low]
    return profile, place


def window_distance(x: np.ndarray, i: int, j: int, w: int) -> float:
    return float(np.sqrt(((x[i : i + w] - x[j : j + w]) ** 2).sum() / w))


def window_distances(x: np.ndarray, i: int, w: int) -> np.ndarray:
    """Distance of window i to every window."""
    n = len(x) - w + 1
    return np.sqrt(sum(((x[k : k + n] - x[i + k]) ** 2).sum(1) for k in range(w)) / w)


def motifs(x: np.ndarray, w: int, most: int = 5, exclusion: float = 0.5) -> list[dict]:
    """Recurring windows, best first: canonical place, occurrences (place, distance), period, mean distance (the canonical window's own 0 counts).

    Further occurrences lie within twice the best distance and keep clear of the candidate and its neighbour, not of
    each other; places near an occurrence give no candidate any more.
    """
    profile, place = matrix_profile(x, w, exclusion)
    n, zone = len(profile), max(1, math.ceil(w * exclusion))
    used = np.zeros(n, bool)
    out: list[dict] = []
    for i in map(int, np.argsort(profile, kind="stable")):
        if len(out) >= most or not np.isfinite(profile[i]):
            break
        if used[i]:
            continue
        j, limit, at = int(place[i]), max(2 * profile[i], 1e-6), np.arange(n)
        free = np.flatnonzero((np.abs(at - i) >= zone) & (np.abs(at - j) >= zone))
        d = window_distances(x, i, w)[free]
        found = sorted([(i, 0.0), (j, float(profile[i])), *((int(k), float(v)) for k, v in zip(free[d <= limit], d[d <= limit]))])
        for o, _ in found:
            used[max(0, o - zone) : o + zone] = True
        out.append({"canonical": i, "occurrences": found, "period": period([o for o, _ in found]), "mean_distance": float(np.mean([d for _, d in found]))})
    return out


def period(places: list[int]) -> int | None:
    """Median gap of three places or more if every gap is within a fifth of it (or 1)."""
    if len(places) < 3:
        return None
    gaps = np.diff(sorted(places))
    mid = float(np.sort(gaps)[len(gaps) // 2])
    return int(mid) if (np.abs(gaps - mid) <= max(0.2 * mid, 1)).all() else None


def discords(x: np.ndarray, w: int, most: int = 5, exclusion: float = 0.5) -> list[tuple[int, float]]:
    """Windows farthest from any other; none begins from zone before one already found to zone - 1 after it."""
    profile, _ = matrix_profile(x, w, exclusion)
    zone = max(1, math.ceil(w * exclusion))
    out: list[tuple[int, float]] = []
    for i in map(int, np.argsort(-profile, kind="stable")):
        if len(out) >= most:
            break
        if np.isfinite(profile[i]) and not any(o - zone <= i < o + zone for o, _ in out):
            out.append((i, float(profile[i])))
    return out


def signature(x: np.ndarray, depth: int = 2, t: np.ndarray | None = None) -> np.ndarray:
    """Truncated path signature up to depth 3 with left-point sums; t, scaled to [0, 1], goes in as a first dimension."""
    if t is not None:
        span = max(float(t[-1] - t[0]), 1e-12)
        x = np.column_stack([(t - t[0]) / span, x])
    dx = np.diff(x, axis=0)
    before = np.vstack([np.zeros(x.shape[1]), np.cumsum(dx, 0)[:-1]])
    parts = [dx.sum(0)]
    if depth >= 2:
        parts.append((before.T @ dx).ravel())
    if depth >= 3:
        outer = np.einsum("ni,nj->nij", before, dx)
        old = np.concatenate([np.zeros((1, *outer.shape[1:])), np.cumsum(outer, 0)[:-1]])
        parts.append(np.einsum("nij,nk->ijk", old, dx).ravel())
    return np.concatenate(parts)


def log_signature(x: np.ndarray, depth: int = 2) -> np.ndarray:
    """First level, then the antisymmetric part of the second above the diagonal, then the third as it is."""
    s, d = signature(x, depth), x.shape[1]
    parts = [s[:d]]
    if depth >= 2:
        two = s[d : d + d * d].reshape(d, d)
        parts.append(((two - two.T) / 2)[np.triu_indices(d, 1)])
    if depth >= 3:
        parts.append(s[d + d * d :])
    return np.concatenate(parts)


def extend_signature(sig: np.ndarray, last: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Levels one and two after one more point; a third level stays as it was."""
    d, out = len(last), sig.copy()
    dx = new - last
    if len(sig) >= d + d * d:
        out[d : d + d * d] += np.outer(sig[:d], dx).ravel()
    out[:d] += dx
    return out


def frechet(a: np.ndarray, b: np.ndarray) -> float:
    """Discrete Fréchet distance; infinite if a side is empty."""
    if not len(a) or not len(b):
        return math.inf
    d = np.sqrt(np.maximum(((a[:, None] - b[None]) ** 2).sum(-1), 0))
    row = np.maximum.accumulate(d[0])
    for i in range(1, len(a)):
        best = np.minimum(row, np.concatenate([[math.inf], row[:-1]]))
        new = np.empty_like(row)
        new[0] = max(row[0], d[i, 0])
        for j in range(1, len(b)):
            new[j] = max(min(best[j], new[j - 1]), d[i, j])
        row = new
    return float(row[-1])


def tree_edges(x: np.ndarray) -> np.ndarray:
    """Sorted edge lengths of a minimum spanning tree: the deaths of connected components as balls grow."""
    n = len(x)
    if n < 2:
        return np.zeros(0)
    near, inside, out = np.full(n, np.inf), np.zeros(n, bool), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        near = np.minimum(near, np.sqrt(((x - x[at]) ** 2).sum(1)))
        at = int(np.argmin(np.where(inside, np.inf, near)))
        out.append(near[at])
    return np.sort(out)


def middles(top: float, n: int) -> np.ndarray:
    """The middles of n equal bins up to top."""
    return (np.arange(n) + 0.5) * top / n


def diagram(x: np.ndarray) -> list[tuple[float, float]]:
    """(birth, death) of every connected component as balls grow; all are born at 0, one never dies."""
    return [(0.0, float(d)) for d in tree_edges(x)] + [(0.0, math.inf)] * (len(x) > 0)


def betti(intervals: list[tuple[float, float]], radii: np.ndarray) -> list[int]:
    """How many components live at each radius."""
    b, d = (np.array(v, float) for v in zip(*intervals)) if intervals else (np.zeros(0), np.zeros(0))
    return [int(((b <= r) & (d > r)).sum()) for r in radii]


def topology(x: np.ndarray, radii: int = 20, threshold: float = 0.0) -> dict:
    """Components that outlive threshold (the one that never dies counts), total, largest and mean lifetime, their entropy, and Betti numbers at the middles of equal bins."""
    death = tree_edges(x)
    total = float(death.sum())
    top = float(death.max()) if len(death) else 0.0
    p = death[death > 0] / total if total > 0 else np.zeros(0)
    mids = middles(top, radii)
    return {"n_components": int((death > threshold).sum()) + (len(x) > 0), "total_persistence": total, "max_persistence": top, "mean_persistence": float(death.mean()) if len(death) else 0.0, "entropy": float(-(p * np.log(p)).sum()), "radii": mids.tolist(), "betti": betti(diagram(x), mids)}
