"""Nearest-neighbour searches: snapshot, range, recency, reward, metadata, scored, hybrid, causal, batch.

Exact: a search is a filter that reaches the scan, a score, and a top-k that plans as TakeOrderedAndProject.
candidate_pool reproduces the two-stage rule of approximate engines: the pool's nearest by raw distance are
scored again. Ties go to the lower node_id. Fewer matches than k give fewer rows; no match gives none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions import scoring, vectors
from vectide.functions.filters import ALL, MetadataFilter, TemporalFilter

MOST_QUERIES = 10_000


@dataclass(frozen=True)
class SearchSpec:
    vector: Sequence[float]
    k: int = 10
    when: TemporalFilter = ALL
    alpha: float = 1.0
    query_t: int = 0
    metric: str = "l2"
    metadata: MetadataFilter = MetadataFilter()
    min_reward: float | None = None
    recency_rate: float = 0.0
    recency_weight: float = 0.0
    normalised: bool = True
    candidate_pool: int | None = None


def _span(points: DataFrame) -> DataFrame:
    return F.broadcast(points.agg(F.max("t").alias("last_t"), (F.max("t") - F.min("t")).alias("span_t")))  # one row


def nearest(points: DataFrame, spec: SearchSpec, collection: DataFrame | None = None) -> DataFrame:
    """points' rows of the k best, with semantic_distance, temporal_distance and score; times are normalised over collection (else points)."""
    kept = points.where(spec.when.column())
    if not spec.metadata.is_empty:
        kept = kept.where(spec.metadata.column())
    if spec.min_reward is not None:
        kept = kept.where(F.col("reward").isNotNull() & ~F.isnan("reward") & (F.col("reward") >= spec.min_reward))
    scored = kept.withColumn("semantic_distance", vectors.METRICS[spec.metric](F.col("vector"), spec.vector))
    if spec.candidate_pool:
        scored = scored.orderBy("semantic_distance", "node_id").limit(spec.candidate_pool)
    if spec.alpha >= 1 and not spec.recency_weight:
        scored = scored.withColumn("temporal_distance", F.lit(None).cast("double")).withColumn("score", F.col("semantic_distance"))
    else:
        scored = scored.crossJoin(_span(collection if collection is not None else points))
        sem = scoring.semantic_share(F.col("semantic_distance")) if spec.normalised else F.col("semantic_distance")
        tdist = scoring.temporal_distance(F.col("t"), spec.query_t, F.col("span_t"))
        late = scoring.recency_penalty(F.col("t"), F.col("last_t"), F.col("span_t"), spec.recency_rate)
        scored = scored.withColumn("temporal_distance", tdist).withColumn("score", spec.alpha * sem + (1 - spec.alpha) * tdist + spec.recency_weight * late).drop("last_t", "span_t")
    return scored.orderBy("score", "node_id").limit(spec.k)


def scored_search(points: DataFrame, spec: SearchSpec, weights: scoring.Weights, success: DataFrame | None = None, region: Column | None = None, key: str = "node_id") -> DataFrame:
    """The 4k nearest, scored by a weighted sum of similarity, recency, reward, success and region match; then the k best.

    success: key (node_id or entity_id), success_score (0.5 where missing); only the pool's rows of it are read on. region: a
    boolean column, whether the point is in the query's region.
    """
    pool = nearest(points, SearchSpec(spec.vector, 4 * spec.k, spec.when, 1.0, spec.query_t, spec.metric)).drop("temporal_distance", "score")
    pool = pool.crossJoin(_span(points))
    pool = F.broadcast(pool).join(success.join(F.broadcast(pool.select(key).distinct()), key, "left_semi"), key, "left") if success is not None else pool.withColumn("success_score", F.lit(0.5))
    recency = scoring.recency_penalty(F.col("t"), F.col("last_t"), F.col("span_t"), 1.0)
    score = weights.score(scoring.semantic_share(F.col("semantic_distance")), recency, F.col("reward"), F.coalesce("success_score", F.lit(0.5)), region if region is not None else F.lit(False))
    return pool.withColumn("recency", recency).withColumn("score", score).drop("last_t", "span_t").orderBy("score", "node_id").limit(spec.k)


def with_steps(points: DataFrame) -> DataFrame:
    """points with the place of each in its entity's timeline and its neighbours' node ids."""
    w = Window.partitionBy("entity_id").orderBy("t", "node_id")
    return points.withColumn("pos", F.row_number().over(w)).withColumn("before", F.lag("node_id").over(w)).withColumn("after", F.lead("node_id").over(w))


def hybrid_search(points: DataFrame, spec: SearchSpec) -> DataFrame:
    """Nearest points and their temporal neighbours (within the filter), scored alike, the k best; the composite is not normalised."""
    seeds = nearest(points, SearchSpec(spec.vector, spec.k, spec.when, metric=spec.metric)).select("node_id")
    line = points.join(F.broadcast(points.join(F.broadcast(seeds), "node_id", "left_semi").select("entity_id").distinct()), "entity_id", "left_semi")
    steps = with_steps(line).select("node_id", "before", "after")
    near = steps.join(F.broadcast(seeds), "node_id").select(F.explode(F.array("node_id", "before", "after")).alias("node_id")).where("node_id is not null").distinct()
    return nearest(points.join(F.broadcast(near), "node_id", "left_semi"), SearchSpec(spec.vector, spec.k, spec.when, spec.alpha, spec.query_t, spec.metric, normalised=False), points)


def causal_search(points: DataFrame, spec: SearchSpec, context: int) -> DataFrame:
    """Per hit and neighbour in the entity's whole timeline, at most context steps away: node_id, score, entity_id, offset, other_id, other_t.

    offset is negative before the hit (chronological order) and positive after; hits without a neighbour give no row.
    """
    hits = nearest(points, spec).select("node_id", "score", "entity_id")
    line = points.join(F.broadcast(hits.select("entity_id").distinct()), "entity_id", "left_semi")
    steps = with_steps(line).select("entity_id", "node_id", "t", "pos")
    at = hits.join(steps.select("node_id", F.col("pos").alias("hit_pos")), "node_id")
    others = steps.select("entity_id", F.col("node_id").alias("other_id"), F.col("t").alias("other_t"), "pos")
    offset = F.col("pos") - F.col("hit_pos")
    return F.broadcast(at).join(others, "entity_id").where((F.abs(offset) <= context) & (offset != 0)).select("node_id", "score", "entity_id", offset.alias("offset"), "other_id", "other_t")


def batch_nearest(points: DataFrame, queries: Sequence[Sequence[float]], k: int, metric: str = "l2") -> DataFrame:
    """query, node_id, score for many queries at once: one matrix product per batch of rows, k rows per query and partition travel on.

    A product in single precision tells which pairs may be among a query's k best; only those are settled in double.
    """
    if len(queries) > MOST_QUERIES:
        raise ValueError(f"at most {MOST_QUERIES} queries at once; larger sets belong in a table and in a join")
    q = np.asarray(queries, np.float64).reshape(len(queries), -1)

    def exact(i: np.ndarray, x: np.ndarray) -> np.ndarray:
        a = q[i]
        if metric == "l2":
            return ((a - x) ** 2).sum(1)
        p = (a * x).sum(1)
        if metric == "dot":
            return -p
        s = np.sqrt((a * a).sum(1)) * np.sqrt((x * x).sum(1))
        return np.where(s < vectors.TINY, 1.0, 1 - np.clip(p / np.maximum(s, 1e-300), -1, 1))

    def settled(i: np.ndarray, ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query, in order."""
        order = np.lexsort((ids, d, i))
        i, ids, d = i[order], ids[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        return i[place < k], ids[place < k], d[place < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.linalg.norm(q, axis=1)
        unit = q / np.maximum(size, 1e-300)[:, None] if metric == "cosine" else q
        q32, nq = unit.astype(np.float32), (size * size).astype(np.float32)[:, None]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        limit = np.full(len(q), np.inf)
        for b in batches:
            for start in range(0, b.num_rows if len(q) and k > 0 else 0, 4096):
                part = b.slice(start, 4096)
                ids, x = part.column(0).to_numpy(), np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                nx = np.linalg.norm(x, axis=1)
                x32 = (x / np.maximum(nx, 1e-300)[:, None] if metric == "cosine" else x).astype(np.float32)
                d = q32 @ x32.T
                if metric == "l2":
                    d *= -2
                    d += nq
                    d += (nx * nx).astype(np.float32)
                else:
                    np.subtract(np.float32(metric == "cosine"), d, out=d)
                    if metric == "cosine":
                        d[:, nx < vectors.TINY], d[size < vectors.TINY] = 1, 1
                off = 1e-5 * (1 if metric == "cosine" else (size.max() + nx.max()) ** 2)
                if not np.isfinite(limit).all():
                    first = min(k, d.shape[1]) - 1
                    limit = np.minimum(limit, np.partition(d, first, axis=1)[:, first] + 2 * off if first == k - 1 else np.inf)
                i, j = np.nonzero(d <= (limit + off)[:, None].astype(np.float32))
                best = settled(np.r_[best[0], i], np.r_[best[1], ids[j]], np.r_[best[2], exact(i, x[j])])
                full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) == k)
                limit[full] = best[2][np.searchsorted(best[0], full, side="right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(best[0].astype(np.int32)), pa.array(best[1]), pa.array(best[2])], ["query", "node_id", "score"])

    part = points.select("node_id", "vector").mapInArrow(run, "query int, node_id long, score double")
    w = Window.partitionBy("query").orderBy("score", "node_id")
    return part.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def recall(found: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """One row: the share of truth's rows that found has, over max(rows of truth, 1)."""
    return found.select(*by).distinct().join(truth.select(*by).distinct(), by).agg(F.count(F.lit(1)).alias("hit")).crossJoin(truth.select(*by).distinct().agg(F.count(F.lit(1)).alias("n"))).select((F.col("hit") / F.greatest("n", F.lit(1))).alias("recall"))


def centroid(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """dim, mean per dimension of all vectors (per group); partial aggregates of one row per dimension; no point gives no row."""
    return points.select(*(by or []), F.posexplode("vector").alias("dim", "x")).groupBy(*(by or []), "dim").agg(F.avg("x").alias("mean"))


def centroid_vector(points: DataFrame) -> DataFrame:
    """The centroid as one row with one array."""
    return centroid(points).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("centroid"))


def set_rewards(points: DataFrame, updates: DataFrame) -> DataFrame:
    """points with the rewards of updates (node_id, reward, and version to tell the latest of several; null versions lose) in place of their own."""
    latest = updates.where("node_id is not null").groupBy("node_id").agg(F.max_by("reward", F.struct(F.coalesce("version", F.lit(-1)), "reward")).alias("new"), F.lit(True).alias("hit"))
    return points.join(latest, "node_id", "left").withColumn("reward", F.when(F.col("hit"), F.col("new")).otherwise(F.col("reward"))).drop("new", "hit")


def nearest_over(parts: Sequence[DataFrame], spec: SearchSpec) -> DataFrame:
    """One search over several stores (say a compacted one and a fresh buffer), by one score; a node in several counts once, from the first."""
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    every = tagged[0]
    for p in tagged[1:]:
        every = every.unionByName(p)
    rest = [c for c in parts[0].columns if c != "node_id"]
    once = every.groupBy("node_id").agg(F.min_by(F.struct(*rest), "__part").alias("r")).select("node_id", *[F.col("r")[c].alias(c) for c in rest])
    return nearest(once, spec)


def diverse(ranked: DataFrame, k: int) -> DataFrame:
    """Of candidates (node_id, score, vector) those that are nearer to the query than to any chosen before, best first, at most k.

    Each choice is one top-1 over the candidates that no earlier choice has shut out, so there may be any number of them.
    """
    spark, left, chosen = ranked.sparkSession, ranked.select("node_id", "score", "vector"), []
    while len(chosen) < k:
        top = left.orderBy("score", "node_id").limit(1).collect()
        if not top:
            break
        chosen.append((top[0]["node_id"], top[0]["score"]))
        left = left.where((F.col("node_id") != top[0]["node_id"]) & (vectors.l2_squared("vector", [float(x) for x in top[0]["vector"]]) > F.col("score")))
    return spark.createDataFrame(chosen, "node_id long, score double")


def active_neighbours(primary: Column, backup: Column, expired: Column, most: int) -> Column:
    """Primary neighbours that haven't expired, filled up with backups that are neither expired nor among them."""
    live = F.array_except(primary, expired)
    return F.slice(F.array_union(live, F.array_except(backup, expired)), 1, most)
