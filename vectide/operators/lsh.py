"""Temporal locality-sensitive hashing: tables keyed by hyperplane bits and a time bucket, probed around, re-ranked exactly."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class LshConfig:
    tables: int = 16
    bits: int = 12
    bucket_us: int = DAY_US
    time_probes: int = 1
    flips: int = 3
    seed: int = 42

    @classmethod
    def for_alpha(cls, alpha: float, dim: int) -> LshConfig:
        """Sixteen bits shared out by the weight of meaning against time."""
        return cls(bits=max(2, min(14, round(16 * alpha))), flips=5 if dim > 100 else 3)

    def planes(self, dim: int) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.tables, self.bits, dim))


def _code(v: Column, planes: np.ndarray) -> Column:
    bits = [F.when(vectors.dot(v, [float(x) for x in p]) >= 0, 1 << i).otherwise(0) for i, p in enumerate(planes)]
    return sum(bits[1:], bits[0])


def build(points: DataFrame, dim: int, cfg: LshConfig) -> DataFrame:
    """node_id with its cells (table, code, bucket); to be written once and joined by equality."""
    cells = F.array(*[F.struct(F.lit(i).alias("table"), _code(F.col("vector"), p).alias("code")) for i, p in enumerate(cfg.planes(dim))])
    bucket = F.floor(F.col("t") / cfg.bucket_us).cast("long")
    return points.select("node_id", bucket.alias("bucket"), F.explode(cells).alias("c")).select("node_id", "c.table", "c.code", "bucket")


def candidates(index: DataFrame, query: Sequence[float], query_t: int, cfg: LshConfig) -> DataFrame:
    """Distinct node_ids met in any probed cell; the probes are a fixed number of literals."""
    signs = [sum((1 << b) for b, p in enumerate(t) if float(np.dot(p, query)) >= 0) for t in cfg.planes(len(query))]
    home = query_t // cfg.bucket_us
    probes = [(i, s ^ flip, home + o) for i, s in enumerate(signs) for flip in [0, *(1 << b for b in range(min(cfg.flips, cfg.bits)))] for o in range(-cfg.time_probes, cfg.time_probes + 1)]
    asked = index.sparkSession.createDataFrame(probes, "table int, code int, bucket long")
    return index.join(F.broadcast(asked), ["table", "code", "bucket"], "left_semi").select("node_id").distinct()


def search(points: DataFrame, index: DataFrame, query: Sequence[float], query_t: int, k: int, cfg: LshConfig) -> DataFrame:
    hits = points.join(candidates(index, query, query_t, cfg), "node_id", "left_semi")
    return hits.withColumn("score", vectors.l2_squared(F.col("vector"), query)).orderBy("score", "node_id").limit(k)
