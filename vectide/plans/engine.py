"""The typed queries in one place: a dataclass goes in, a DataFrame comes out. Composite reports are at the end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors
from vectide.functions.filters import ALL, TemporalFilter
from vectide.operators import cohort, joins, mining, search
from vectide.operators import trajectory as tr
from vectide.operators.search import SearchSpec

WEEK_US = 7 * 86_400_000_000


@dataclass(frozen=True)
class SnapshotKnn:
    vector: Sequence[float]
    timestamp: int
    k: int = 10


@dataclass(frozen=True)
class RangeKnn:
    vector: Sequence[float]
    start: int
    end: int
    k: int = 10
    alpha: float = 1.0


@dataclass(frozen=True)
class Trajectory:
    entity_id: int
    when: TemporalFilter = ALL


@dataclass(frozen=True)
class Velocity:
    entity_id: int
    timestamp: int


@dataclass(frozen=True)
class Prediction:
    entity_id: int
    target: int


@dataclass(frozen=True)
class ChangePoints:
    entity_id: int
    start: int
    end: int


@dataclass(frozen=True)
class Drift:
    entity_id: int
    t1: int
    t2: int
    top_n: int = 5


@dataclass(frozen=True)
class Analogy:
    entity_a: int
    t1: int
    t2: int
    entity_b: int
    t3: int


@dataclass(frozen=True)
class Counterfactual:
    entity_id: int
    change_point: int


@dataclass(frozen=True)
class Granger:
    entity_a: int
    entity_b: int
    max_lag: int = 5
    significance: float = 0.05


@dataclass(frozen=True)
class Motifs:
    entity_id: int
    window: int
    most: int = 5


@dataclass(frozen=True)
class Discords:
    entity_id: int
    window: int
    most: int = 5


@dataclass(frozen=True)
class TemporalJoin:
    entity_a: int
    entity_b: int
    epsilon: float
    window_us: int = WEEK_US


@dataclass(frozen=True)
class CohortDrift:
    entity_ids: Sequence[int]
    t1: int
    t2: int
    top_n: int = 5


@dataclass(frozen=True)
class CausalSearch:
    vector: Sequence[float]
    k: int = 10
    when: TemporalFilter = ALL
    alpha: float = 1.0
    query_timestamp: int = 0
    temporal_context: int = 5


def _pair(points: DataFrame, a: int, b: int) -> DataFrame:
    return points.sparkSession.range(1).select(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))


def execute(points: DataFrame, q: object) -> DataFrame:
    """The answer of one typed query. An unknown entity gives no row, too short a trajectory neither."""
    one = lambda e: points.where(F.col("entity_id") == e)
    knn = lambda spec: search.nearest(points, spec).select("entity_id", "t", "score")
    match q:
        case SnapshotKnn():
            return knn(SearchSpec(q.vector, q.k, TemporalFilter.snapshot(q.timestamp)))
        case RangeKnn():
            return knn(SearchSpec(q.vector, q.k, TemporalFilter.between(q.start, q.end), q.alpha, q.start + (q.end - q.start) // 2))
        case Trajectory():
            return tr.trajectory(points, q.entity_id, q.when.column())
        case Velocity():
            return tr.velocity(one(q.entity_id), q.timestamp)
        case Prediction():
            return tr.predict_linear(one(q.entity_id), q.target).withColumn("method", F.lit("linear"))
        case ChangePoints():
            return mining.change_points(one(q.entity_id).where(TemporalFilter.between(q.start, q.end).column()))
        case Drift():
            return tr.drift(one(q.entity_id), q.t1, q.t2, q.top_n)
        case Analogy():
            return tr.analogy(points, q.entity_a, q.t1, q.t2, q.entity_b, q.t3)
        case Counterfactual():
            return cohort.counterfactual(one(q.entity_id), q.change_point)
        case Granger():
            return mining.granger(points, _pair(points, q.entity_a, q.entity_b), q.max_lag, q.significance)
        case Motifs():
            return mining.motifs(one(q.entity_id), q.window, q.most)
        case Discords():
            return mining.discords(one(q.entity_id), q.window, q.most)
        case TemporalJoin():
            return joins.temporal_join(_pair(points, q.entity_a, q.entity_b), points, q.epsilon, q.window_us)
        case CohortDrift():
            return cohort.cohort_drift(points.where(F.col("entity_id").isin(*q.entity_ids)), q.t1, q.t2, q.top_n)
        case CausalSearch():
            return search.causal_search(points, SearchSpec(q.vector, q.k, q.when, q.alpha, q.query_timestamp), q.temporal_context)
    raise ValueError(f"no such query: {type(q).__name__}")


def _reading(drift: Column, strong: str) -> Column:
    return F.when(drift < 0.1, "Minimal change").when(drift < 0.5, "Moderate drift").otherwise(strong)


def entity_summaries(points: DataFrame, penalty: float | None = None, start: int | None = None, end: int | None = None, top_n: int = 5) -> DataFrame:
    """Per entity with a point in [start, end]: first and last time, count, drift from first to last point (L2, cosine, a reading, the dimensions that changed most), change points, speed at the last point (per day), and all that in a sentence.

    Change points need four points or more; the speed is null for one point.
    """
    kept = points if start is None else points.where(F.col("t") >= start)
    kept = kept if end is None else kept.where(F.col("t") <= end)
    key = F.struct("t", "node_id")
    line = kept.groupBy("entity_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n_points"), F.min_by("vector", key).alias("v0"), F.max_by("vector", key).alias("v1"))
    w = tr.W()
    last = kept.select("entity_id", "vector", F.lag("vector").over(w).alias("p"), (F.col("t") - F.lag("t").over(w)).alias("dt"), F.lead("t").over(w).alias("later")).where("later is null and p is not null")
    speed = last.select("entity_id", F.when(F.col("dt") > 0, vectors.l2("vector", "p") / F.nullif(F.col("dt"), F.lit(0)) * tr.DAY_US).otherwise(0.0).alias("speed"))
    found = mining.change_points(kept, penalty).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("t", "severity"))).alias("changes"))
    top = vectors.top_dims(vectors.subtract("v1", "v0"), top_n)
    drift = vectors.l2("v0", "v1")
    out = line.join(speed, "entity_id", "left").join(found, "entity_id", "left").select(
        "entity_id", "first_t", "last_t", "n_points", drift.alias("drift"), vectors.cosine_distance("v0", "v1").alias("drift_cosine"), _reading(drift, "Significant semantic shift").alias("reading"), top.alias("top_dimensions"),
        F.coalesce("changes", F.array().cast("array<struct<t:bigint,severity:double>>")).alias("changes"), "speed",
    )
    said = F.format_string("Entity %d has %d points spanning %d to %d. %s. L2 drift: %.4f. %d change point(s) detected.", "entity_id", "n_points", "first_t", "last_t", "reading", "drift", F.size("changes"))
    return out.withColumn("n_changes", F.size("changes")).withColumn("summary", said)


def drift_readings(points: DataFrame, t1: int, t2: int, top_n: int = 5) -> DataFrame:
    """Each entity's drift between the points nearest to two times, with a reading and a sentence."""
    d = tr.drift(points, t1, t2, top_n)
    said = F.format_string("Entity %d shows %s (L2=%.4f, cosine=%.4f) between t1 and t2.", "entity_id", "reading", "l2", "cosine")
    return d.withColumn("reading", _reading(F.col("l2"), "Significant shift")).withColumn("summary", said)


def forecasts(points: DataFrame, target: int) -> DataFrame:
    """Each entity's linear forecast, with its size and a sentence."""
    p = tr.predict_linear(points, target)
    return p.select("entity_id", F.lit(target).alias("target_t"), F.lit("linear").alias("method"), F.size("prediction").alias("n_dims"), "prediction").withColumn("summary", F.format_string("Predicted position for entity %d at t=%d using linear extrapolation (%d-dim vector).", "entity_id", "target_t", "n_dims"))


def anomaly_scan(points: DataFrame, lookback_us: int = WEEK_US, penalty: float | None = None) -> DataFrame:
    """Change points of every entity within lookback of its last point, most severe first."""
    last = points.groupBy("entity_id").agg(F.max("t").alias("last_t"))
    near = points.join(last, "entity_id").where(F.col("t") >= F.col("last_t") - lookback_us).drop("last_t")
    return mining.change_points(near, penalty).select("entity_id", "t", F.round("severity", 6).alias("severity")).orderBy(F.desc("severity"), "entity_id", "t")


def compare_entities(points: DataFrame, a: int, b: int, epsilon: float = 0.5, window_us: int = WEEK_US) -> DataFrame:
    """start, stop, mean_distance, min_distance of each convergence window of two entities, with a sentence on all of them; none gives no row."""
    met = joins.temporal_join(_pair(points, a, b), points, epsilon, window_us).select("start", "stop", "mean_distance", "min_distance")
    n = F.broadcast(met.agg(F.count(F.lit(1)).alias("n_windows")))  # one row
    return met.crossJoin(n).withColumn("summary", F.format_string(f"Found %d convergence window(s) between entities {a} and {b}.", "n_windows"))


def compare_causes(points: DataFrame, a: int, b: int, max_lag: int = 5) -> DataFrame:
    """Whether one of two entities leads the other, over whole vectors."""
    return mining.granger(points, _pair(points, a, b), max_lag)


def cohort_reading(drift: DataFrame) -> DataFrame:
    """cohort_drift's row with a word for how the dispersion changed."""
    c = F.col("dispersion_change")
    return drift.withColumn("reading", F.when(c < -0.05, "converging").when(c > 0.05, "diverging").otherwise("stable"))
