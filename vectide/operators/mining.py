"""Sequential kernels over whole trajectories, one call per entity, in Arrow batches.

What is sequential along a trajectory needs that trajectory in one task: memory is bounded by the longest one
(one vector per point). Everything that windows or partial aggregates can express is in trajectory.py instead.
Entities that are too short give no row; points with equal times keep the order of node_id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.kernels import changes, patterns, statistics
from vectide.session import width


def per_entity(points: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows of kernel(times, vectors) for each entity, with entity_id in front."""
    names = ["entity_id", *[p.split()[0] for p in schema.split(", ")]]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "node_id"])
        rows = kernel(pdf["t"].to_numpy(), np.stack(pdf["vector"].to_numpy()).astype(float))
        return pd.DataFrame([(key[0], *r) for r in rows], columns=names)

    return points.select("entity_id", "t", "node_id", "vector").groupBy("entity_id").applyInPandas(run, f"entity_id long, {schema}")


def change_points(points: DataFrame, penalty: float | None = None, least: int = 2) -> DataFrame:
    """entity_id, t, severity, drift, method: optimal segmentation of each trajectory."""
    def kernel(t, x):
        found = [(i, *changes.severity(x, i)) for i in changes.segments(x, penalty, least)]
        return [(int(t[i]), size, drift.tolist(), "pelt") for i, size, drift in found]

    return per_entity(points, kernel, "t long, severity double, drift array<double>, method string")


def online_changes(points: DataFrame, rate: float = 0.05, threshold: float = 3.0, wait: int = 5) -> DataFrame:
    """entity_id, t, severity, drift, method: what the online detector would have said, point by point."""
    def kernel(t, x):
        detector = changes.Online(rate, threshold, wait)
        return [(int(a), hit[0], hit[1].tolist(), "online") for a, v in zip(t, x) if (hit := detector.observe(v))]

    return per_entity(points, kernel, "t long, severity double, drift array<double>, method string")


def hurst(points: DataFrame, least: int = 10) -> DataFrame:
    return per_entity(points, lambda t, x: [(statistics.hurst(x),)] if len(x) >= least else [], "hurst double")


def motifs(points: DataFrame, window: int, most: int = 5) -> DataFrame:
    """entity_id, rank, canonical, start, t, distance, period, mean_distance: one row per occurrence."""
    def kernel(t, x):
        return [(r, m["canonical"], o, int(t[o]), d, m["period"], m["mean_distance"]) for r, m in enumerate(patterns.motifs(x, window, most)) for o, d in m["occurrences"]]

    return per_entity(points, kernel, "rank int, canonical int, start int, t long, distance double, period int, mean_distance double")


def discords(points: DataFrame, window: int, most: int = 5) -> DataFrame:
    return per_entity(points, lambda t, x: [(r, i, int(t[i]), d) for r, (i, d) in enumerate(patterns.discords(x, window, most))], "rank int, start int, t long, distance double")


def matrix_profile(points: DataFrame, window: int) -> DataFrame:
    def kernel(t, x):
        p, at = patterns.matrix_profile(x, window)
        return [(i, float(d), int(j)) for i, (d, j) in enumerate(zip(p, at)) if j >= 0]

    return per_entity(points, kernel, "start int, distance double, nearest int")


def signatures(points: DataFrame, depth: int = 2, time: bool = False, log: bool = False) -> DataFrame:
    """entity_id, n_points, signature; needs two points. Time, if wanted, is scaled to [0, 1]."""
    def kernel(t, x):
        if len(x) < 2:
            return []
        s = patterns.log_signature(x, depth) if log else patterns.signature(x, depth, t.astype(float) if time else None)
        return [(len(x), s.tolist())]

    return per_entity(points, kernel, "n_points int, signature array<double>")


def trajectory_search(points: DataFrame, recent: Sequence[Sequence[float]], k: int, depth: int = 2) -> DataFrame:
    """entity_id, distance, n_points of the k entities whose signature is nearest to that of a recent path; another length is infinitely far."""
    from vectide.functions import vectors

    want = patterns.signature(np.asarray(recent, float), depth).tolist()
    s = signatures(points, depth)
    return s.select("entity_id", F.coalesce(vectors.l2("signature", want), F.lit(float("inf"))).alias("distance"), "n_points").orderBy("distance", "entity_id").limit(k)


def topology(points: DataFrame, radii: int = 20, threshold: float = 0.0) -> DataFrame:
    def kernel(t, x):
        f = patterns.topology(x, radii, threshold)
        return [tuple(f[c] for c in ("n_components", "total_persistence", "max_persistence", "mean_persistence", "entropy", "radii", "betti"))]

    return per_entity(points, kernel, "n_components int, total_persistence double, max_persistence double, mean_persistence double, entropy double, radii array<double>, betti array<int>")


def persistence(points: DataFrame) -> DataFrame:
    """entity_id, birth, death (infinite for one) of each trajectory's connected components."""
    return per_entity(points, lambda t, x: patterns.diagram(x), "birth double, death double")


def betti_curve(points: DataFrame, radii: Sequence[float]) -> DataFrame:
    """entity_id, radius, betti: how many connected components each trajectory has at given radii."""
    return per_entity(points, lambda t, x: list(zip(map(float, radii), patterns.betti(patterns.diagram(x), np.asarray(radii, float)))), "radius double, betti int")


def plane(points: DataFrame) -> DataFrame:
    """entity_id, t, x, y: each trajectory on its own first two principal axes."""
    def kernel(t, x):
        return [] if len(x) < 2 else [(int(a), float(p[0]), float(p[1])) for a, p in zip(t, statistics.principal_plane(x))]

    return per_entity(points, kernel, "t long, x double, y double")


def temporal_features(points: DataFrame, scales: Sequence[int] = (1_000_000, 10_000_000, 100_000_000)) -> DataFrame:
    """entity_id, features: mean velocity per dimension (last less first over the whole time, per µs), drift first to last, volatility per dimension (sample deviation of step rates per µs, 0 under three points), soft change count, mean drift per scale; 2 D + 2 + S numbers. A time of 0 counts as 1 µs."""
    def kernel(t, x):
        if len(x) < 2:
            return []
        v = np.diff(x, axis=0) / np.maximum(np.diff(t), 1)[:, None]
        mean = (x[-1] - x[0]) / max(int(t[-1] - t[0]), 1)
        drift = []
        for s in scales:
            b = (t - t[0]) // s
            last = x[np.r_[np.flatnonzero(b[1:] != b[:-1]), len(b) - 1]]
            drift.append(float(np.linalg.norm(np.diff(last, axis=0), axis=1).mean()) if len(last) > 1 else 0.0)
        vol = v.std(0, ddof=1) if len(v) > 1 else np.zeros(x.shape[1])
        return [([*mean.tolist(), float(np.linalg.norm(x[-1] - x[0])), *vol.tolist(), float(changes.soft_changes(x)), *drift],)]

    return per_entity(points, kernel, "features array<double>")


def _pairs(points: DataFrame, pairs: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """Rows of kernel(ta, a, tb, b) for each pair (a, b); a pair without points on one side gives none."""
    names = ["a", "b", *[p.split()[0] for p in schema.split(", ")]]
    p = points.select("entity_id", "t", "node_id", "vector")
    # fresh aliases: both sides come from the same tables
    side = lambda s: pairs.join(p, F.col(s) == F.col("entity_id")).select(*[F.col(c).alias(c) for c in ("a", "b", "t", "node_id", "vector")])

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        left, right = left.sort_values(["t", "node_id"]), right.sort_values(["t", "node_id"])
        arr = lambda d: np.stack(d["vector"].to_numpy()).astype(float)
        return pd.DataFrame([(*key, *r) for r in kernel(left["t"].to_numpy(), arr(left), right["t"].to_numpy(), arr(right))], columns=names)

    return side("a").groupBy("a", "b").cogroup(side("b").groupBy("a", "b")).applyInPandas(run, f"a long, b long, {schema}")


def frechet(points: DataFrame, pairs: DataFrame) -> DataFrame:
    return _pairs(points, pairs, lambda ta, a, tb, b: [(patterns.frechet(a, b),)], "distance double")


def granger(points: DataFrame, pairs: DataFrame, lags: int = 5, significance: float = 0.05, exact: bool = True) -> DataFrame:
    """a, b, direction, lag, f, p, effect, per_dimension_a_to_b, per_dimension_b_to_a (F values) after both are brought to the times of the longer one; no row for fewer than three points on a side or lags + 3 times."""
    def kernel(ta, a, tb, b):
        if min(len(ta), len(tb)) < 3 or max(len(ta), len(tb)) < lags + 3:
            return []
        a, b = statistics.align(ta, a, tb, b)
        ab, ba = statistics.granger(a, b, lags, exact), statistics.granger(b, a, lags, exact)
        r = statistics.reading(ab, ba, significance)
        return [(r["direction"], r["lag"], r["f"], r["p"], r["effect"], ab["per_dimension"], ba["per_dimension"])]

    return _pairs(points, pairs, kernel, "direction string, lag int, f double, p double, effect double, per_dimension_a_to_b array<double>, per_dimension_b_to_a array<double>")


def first_largest_group(x: np.ndarray, epsilon: float) -> np.ndarray:
    """Rows of the first largest greedy group: from each row in order, later ones join if near to all members.

    Who is near and later is one bit a pair; the candidates of many rows are cut by each one's next member at once, and
    rows that can't beat the largest group of former rows are left.
    """
    n, limit, sq = len(x), epsilon * epsilon, (x * x).sum(1)
    near = np.zeros((n, -(-n // 64)), np.uint64)
    for lo in range(0, n, 512):
        d = sq[lo : lo + 512, None] + sq[None] - 2 * x[lo : lo + 512] @ x.T
        ok = d <= limit
        r, c = np.nonzero(np.abs(d - limit) <= 1e-9 * (sq.max() + limit))  # within rounding: by the differences
        for k in range(0, len(r), 8_192):
            i, j = r[k : k + 8_192], c[k : k + 8_192]
            ok[i, j] = ((x[lo + i] - x[j]) ** 2).sum(1) <= limit
        ok &= np.arange(n) > np.arange(lo, lo + len(ok))[:, None]
        near.view(np.uint8)[lo : lo + len(ok), : -(-n // 8)] = np.packbits(ok, axis=1, bitorder="little")

    def first(left: np.ndarray) -> np.ndarray:
        word = (left != 0).argmax(1)
        bits = left[np.arange(len(left)), word]
        return word * 64 + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1))

    most, start = 0, 0
    for lo in range(0, n, 1_024):
        if n - lo <= most:
            break
        sizes = np.ones(min(1_024, n - lo), np.int64)
        rows, left = np.arange(len(sizes)), near[lo : lo + 1_024]
        while True:
            more = np.bitwise_count(left).sum(1, dtype=np.int64)
            keep = (more > 0) & (sizes[rows] + more > most)
            rows, left = rows[keep], left[keep]
            if not len(rows):
                break
            left &= near[first(left)]
            sizes[rows] += 1
        if sizes.max() > most:
            most, start = int(sizes.max()), lo + int(sizes.argmax())
    members, left = [start][:n], near[start : start + 1]
    while left.any():
        members.append(int(first(left)[0]))
        left = left & near[members[-1]]
    return np.array(members, np.int64)


def group_temporal_join(points: DataFrame, epsilon: float, least_entities: int, window_us: int) -> DataFrame:
    """start, stop, entities, mean_distance: windows in which at least so many entities' centroids are within epsilon of each other, overlapping windows merged.

    Greedy groups: from each entity in order of id, later ones join if near to all members; the first largest group counts.
    Centroids are partial aggregates; a window's task holds one centroid per entity, not its points.
    """
    from vectide.operators.joins import window_centroids

    def group(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entity_id")
        ids, x = pdf["entity_id"].to_numpy(), np.stack(pdf["centroid"].to_numpy()).astype(float)
        best = first_largest_group(x, epsilon)
        if len(best) < least_entities:
            return pd.DataFrame(columns=["start", "stop", "entities", "mean_distance"])
        m = x[best]
        d = sum(float(np.sqrt(((m[i + 1 :] - m[i]) ** 2).sum(1)).sum()) for i in range(len(m)))
        return pd.DataFrame({"start": [key[0]], "stop": [key[1]], "entities": [ids[best].tolist()], "mean_distance": [d / max(1, len(m) * (len(m) - 1) // 2)]})

    # so many partitions that small windows don't share one task
    apart = window_centroids(points, window_us).repartition(4 * width(points.sparkSession), "start", "stop")
    found = apart.groupBy("start", "stop").applyInPandas(group, "start long, stop long, entities array<long>, mean_distance double")
    step = max(window_us // 2, 1)

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for s, e, ids, m in pdf.sort_values("start")[["start", "stop", "entities", "mean_distance"]].itertuples(index=False):
            if out and s <= out[-1][1] + step:
                out[-1] = [out[-1][0], max(e, out[-1][1]), sorted({*out[-1][2], *ids}), (out[-1][3] + m) / 2]
            else:
                out.append([s, e, sorted(ids), m])
        return pd.DataFrame(out, columns=["start", "stop", "entities", "mean_distance"])

    # runs of touching windows are independent of each other and merged apart
    from pyspark.sql import Window

    w = Window.orderBy("start")
    runs = found.withColumn("fresh", F.coalesce((F.col("start") > F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)) + step).cast("int"), F.lit(0))).withColumn("run", F.sum("fresh").over(w))
    return runs.drop("fresh").groupBy("run").applyInPandas(merge, "start long, stop long, entities array<long>, mean_distance double")


def sliced_wasserstein(rows: DataFrame, p: str, q: str, centres: Sequence[Sequence[float]], n: int = 50, seed: int = 42, out: str = "distance") -> DataFrame:
    """rows with the sliced transport distance of two distributions over the same centres."""
    c = np.asarray(centres, float)

    @F.pandas_udf("double")
    def cost(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([statistics.sliced_wasserstein(np.asarray(x), np.asarray(y), c, n, seed) for x, y in zip(a, b)])

    return rows.withColumn(out, cost(p, q))


def region_transport(assigned: DataFrame, hub_table: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """entity_id, distance: sliced transport distance of each entity's region shares to those of all points, over every hub.

    An entity's counts travel sparse; the hubs, which regions.assign bounds, are collected once, so that centres,
    ids and the shares of all keep one order.
    """
    rows = hub_table.orderBy("hub").collect()
    ids, c = np.array([r["hub"] for r in rows], np.int64), np.array([r["hub_vector"] for r in rows], float)
    counts = assigned.groupBy("entity_id", "hub").agg(F.count(F.lit(1)).alias("n"))
    of_all = {r["hub"]: r["n"] for r in assigned.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).collect()}
    q = np.array([of_all.get(int(i), 0) for i in ids], float) / max(sum(of_all.values()), 1)
    shared = assigned.sparkSession.sparkContext.broadcast((ids, q, statistics.projected_orders(c, n, seed) if len(rows) else []))

    @F.pandas_udf("double")
    def cost(hubs: pd.Series, ns: pd.Series) -> pd.Series:
        ids, q, orders = shared.value
        out = []
        for h, k in zip(hubs, ns):
            p = np.zeros(len(ids))
            p[np.searchsorted(ids, h)] = np.asarray(k, float) / k.sum()
            out.append(statistics.transport(p, q, orders))
        return pd.Series(out, dtype=float)

    each = counts.groupBy("entity_id").agg(F.collect_list(F.struct("hub", "n")).alias("x"))
    return each.select("entity_id", cost(F.col("x")["hub"], F.col("x")["n"]).alias("distance"))


def integrate(rows: DataFrame, system: Callable[[float, np.ndarray], np.ndarray], y0: str, t0: str, t1: str, out: str = "y") -> DataFrame:
    """rows with the solution of an ODE from (t0, y0) at t1, each row on its own."""
    @F.pandas_udf("array<double>")
    def solve(y: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([statistics.rk45(system, float(s), np.asarray(v, float), float(e))[0].tolist() for v, s, e in zip(y, a, b)])

    return rows.withColumn(out, solve(y0, t0, t1))
