"""Feature tables for classifiers: position and movement relative to named anchors, and daily activity over several logs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors
from vectide.kernels import statistics
from vectide.operators.mining import per_entity

DAY_US = 86_400_000_000
SMALL = 1e-8


def anchor_features(points: DataFrame, anchors: dict[str, Sequence[float]], healthy: Sequence[float], cutoff: float = 1.0, least: int = 10) -> DataFrame:
    """Per entity of least points or more: how near to each anchor, how spread, how fast.

    The first cutoff of its points (least at least) give n_posts; mean, min and trend (slope against place) of the cosine
    distance to every anchor and to healthy; the anchors' mean distance over healthy's; the Hurst exponent and the
    speed in the middle of the path of distances to the anchors; spread over all points and of the second half over
    the first; mean cosine of all pairs; and of the cosine steps per µs mean, deviation, their ratio, the share above
    mean + 2 deviations, the second half's mean less the first's, and the way over the distance between the ends.
    """
    names = [*anchors, "healthy"]
    a = np.array([*anchors.values(), healthy], float)
    a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), vectors.TINY)
    tail = ["symptom_healthy_ratio", "hurst_anchor_space", "anchor_vel_magnitude", "global_dispersion", "dispersion_ratio", "mean_pairwise_sim", "vel_mean", "vel_std", "vel_cv", "vel_spikes", "tortuosity", "vel_acceleration"]
    schema = ", ".join(["n_posts int", *[f"{n}_{s} double" for n in names for s in ("mean", "min", "trend")], *[f"{c} double" for c in tail]])

    def speed(t: np.ndarray, y: np.ndarray, at: int) -> float:
        i, j = max(at - 1, 0), min(at + 1, len(t) - 1)
        return float(np.linalg.norm((y[j] - y[i]) / (t[j] - t[i]))) if t[j] != t[i] else 0.0

    def kernel(t: np.ndarray, x: np.ndarray) -> list[tuple]:
        if len(x) < least:
            return []
        n = max(least, int(len(x) * cutoff))
        t, x = t[:n], x[:n]
        size = np.linalg.norm(x, axis=1, keepdims=True)
        u = x / np.maximum(size, vectors.TINY)
        d = np.where(size < vectors.TINY, 1.0, 1 - u @ a.T)
        place = np.arange(n) - (n - 1) / 2
        slope = (place @ d) / (place @ place)
        own = d[:, :-1]
        half = n // 2
        spread = lambda z: float(z.std(0).mean())
        total = u.sum(0)
        step = np.where((size[1:] * size[:-1])[:, 0] < vectors.TINY, 1.0, 1 - (u[1:] * u[:-1]).sum(1))
        v = step / np.maximum(np.diff(t), 1)
        mean, std = float(v.mean()), float(v.std())
        mid = int(np.flatnonzero(t == t[half])[0])
        return [(
            n, *[float(z) for k in range(len(names)) for z in (d[:, k].mean(), d[:, k].min(), slope[k])],
            float(own.mean() / (d[:, -1].mean() + SMALL)), statistics.hurst(own), speed(t, own, mid), spread(x), spread(x[half:]) / (spread(x[:half]) + SMALL), float((total @ total - n) / (n * (n - 1))),
            mean, std, std / (mean + SMALL), float((v > mean + 2 * std).mean()), float(step.sum() / (1 - float(u[0] @ u[-1]) + SMALL)), float(v[len(v) // 2 :].mean() - v[: len(v) // 2].mean()),
        )]

    return per_entity(points, kernel, schema)


def daily_features(logs: dict[str, tuple[DataFrame, dict[str, str]]], mail: str | None = None, recipient: str = "recipient", internal: str = "", after: tuple[int, int] = (7, 19)) -> DataFrame:
    """Per user and UTC day on which any log has an event of the user: counts per log and activity, and what the day looks like.

    logs: name to (rows of user, t_us and, if there are, activity, pc and the recipient's address) and the columns to make, column name
    to activity ('' for all). Then n_received (mail sent to the user's name at the internal domain by others or oneself),
    after_hours_ratio over all events, unique_pcs, weekend_flag, and external_ratio of the mail sent (0 without any).
    Days are full outer joined: every log is reduced to (user, day) by a partial aggregate first.
    """
    day = F.floor(F.col("t_us") / DAY_US).cast("long").alias("day")
    hour = F.floor(F.pmod(F.col("t_us"), F.lit(DAY_US)) / 3_600_000_000)
    late = ((hour < after[0]) | (hour >= after[1])).cast("long")
    rows, columns = [], [c for _, made in logs.values() for c in made]
    for name, (log, made) in logs.items():
        known = set(log.columns)
        pick = lambda c: F.col(c).cast("string") if c in known else F.lit(None).cast("string")  # noqa: B023, E731
        away = F.when(F.lit(name == mail) & pick(recipient).isNotNull(), (~F.lower(pick(recipient)).endswith("@" + internal.lower())).cast("long"))
        counts = [F.lit(0) if c not in made else F.when(pick("activity") == made[c], 1).otherwise(0) if made[c] else F.lit(1) for c in columns]
        rows.append(log.where("user is not null and t_us is not null").select(F.col("user").cast("string").alias("user"), day, late.alias("late"), pick("pc").alias("pc"), away.alias("away"), *[x.alias(c) for x, c in zip(counts, columns)]))
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    sums = every.groupBy("user", "day").agg(*[F.sum(c).alias(c) for c in columns], F.avg("late").alias("after_hours_ratio"), F.count_distinct("pc").alias("unique_pcs"), F.coalesce(F.avg("away"), F.lit(0.0)).alias("external_ratio"))
    if mail is None:
        got = sums.select("user", "day", F.lit(0).cast("long").alias("n_received")).where("false")
    else:
        sent = logs[mail][0].where(F.lower(recipient).endswith("@" + internal.lower()))
        got = sent.select(F.substring_index(F.col(recipient), "@", 1).alias("user"), day).groupBy("user", "day").agg(F.count(F.lit(1)).alias("n_received"))
    weekend = F.pmod(F.col("day") + 3, F.lit(7)) >= 5  # day 0 was a Thursday
    return sums.join(got, ["user", "day"], "left").select("user", "day", *columns, F.coalesce("n_received", F.lit(0)).alias("n_received"), "after_hours_ratio", "unique_pcs", weekend.cast("int").alias("weekend_flag"), "external_ratio")
