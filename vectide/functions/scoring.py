"""Scores of the time-aware searches; lower is better."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


def temporal_distance(t: Column, query_t: Column | int, span: Column) -> Column:
    """|t - query| over the whole time span of the collection, at most 1."""
    return F.least(F.abs(t - query_t) / F.greatest(span, F.lit(1)), F.lit(1.0))


def semantic_share(distance: Column) -> Column:
    return F.least(distance / 2, F.lit(1.0))


def recency_penalty(t: Column, last: Column, span: Column, rate: float) -> Column:
    """1 - exp(-rate * age), age from 0 (the newest point) to 1; no penalty for a rate of 0 or less."""
    if rate <= 0:
        return F.lit(0.0)
    return 1 - F.exp(-F.lit(rate) * (last - t) / F.greatest(span, F.lit(1)))


def decay_weight(edge_t: Column, now: Column | int, rate: float) -> Column:
    return F.exp(-F.lit(rate) * F.greatest(F.lit(now) - edge_t, F.lit(0)))


def decayed_distance(distance: Column, weight: Column) -> Column:
    return F.when(weight <= 1e-10, F.lit(float("inf"))).otherwise(distance / F.greatest(weight, F.lit(1e-10)))


@dataclass(frozen=True)
class Weights:
    """Weights of the candidate score."""

    similarity: float = 1.0
    recency: float = 0.0
    reward: float = 0.0
    success: float = 0.0
    region: float = 0.0

    def score(self, similarity: Column, recency: Column, reward: Column, success: Column, same_region: Column) -> Column:
        unknown = F.coalesce(F.nanvl(1 - reward, F.lit(0.5)), F.lit(0.5))
        return self.similarity * similarity + self.recency * recency + self.reward * unknown + self.success * (1 - success) + self.region * F.when(same_region, 0.0).otherwise(1.0)

    def learn(self, means: dict[str, float], outcome: float, n: int, rate: float = 0.05) -> Weights:
        """One step from the mean features of the candidates shown: down after a success (outcome above 0.5), up after a failure."""
        step = (-1 if outcome > 0.5 else 1) * rate / (1 + 0.01 * n)
        return replace(self, **{k: min(2.0, max(0.0, getattr(self, k) + step * v)) for k, v in means.items()})


# fixed values: the weights of the published presets
BALANCED = Weights(1.0, 0.3, 0.5, 0.4, 0.2)
AGENT_MEMORY = Weights(1.0, 0.1, 0.6, 0.5, 0.2)
