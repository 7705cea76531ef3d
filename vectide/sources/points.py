"""Points: node_id, entity_id, t (µs), vector (array<double>), and reward and metadata where the source has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.session import micros, table

# fixed values: reasons of rejection, in the order in which they are looked for
REASONS = ("empty_vector", "wrong_dimension", "timestamp_out_of_range", "nan", "infinite", "zero_vector")


def rejection(vector: str, t: str, dim: int, t_min: int | None = None, t_max: int | None = None, allow_zero: bool = False) -> Column:
    """Why a point can't be taken: the first of REASONS that applies, else null."""
    v = F.col(vector)
    late = F.lit(False)
    if t_min is not None:
        late = late | (F.col(t) < t_min)
    if t_max is not None:
        late = late | (F.col(t) > t_max)
    zero = F.lit(False) if allow_zero else ~F.exists(v, lambda x: x != 0)
    return (
        F.when(v.isNull() | (F.size(v) == 0), "empty_vector").when(F.size(v) != dim, "wrong_dimension").when(F.col(t).isNull() | late, "timestamp_out_of_range")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "nan").when(F.exists(v, lambda x: F.abs(x) == float("inf")), "infinite").when(zero, "zero_vector")
    )


def split_valid(points: DataFrame, dim: int, vector: str = "vector", t: str = "t", **options) -> tuple[DataFrame, DataFrame]:
    """Valid points, and the quarantined ones with their reason; every row is in exactly one of them."""
    marked = points.withColumn("reason", rejection(vector, t, dim, **options))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def latest(points: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order, by a partial aggregate (no sort of whole keys)."""
    rest = [c for c in points.columns if c not in key]
    return points.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in rest]).select(*points.columns)


def ingested(spark: SparkSession, d: str) -> DataFrame:
    """The valid records of ingestpoint, each once (the first node of a sequence), vectors as double, NaN rewards as null.

    Copies of a record agree on time and entity; as grouping keys these let filters on them reach the scan.
    """
    raw = table(spark, d, "ingestpoint").select("node_id", "sequence", "entity_id", "t", "vector", "reward", "metadata")
    valid, _ = split_valid(latest(raw, ["sequence", "t", "entity_id"], [F.col("node_id")]), 64)
    return valid.withColumn("vector", F.col("vector").cast("array<double>")).withColumn("reward", F.when(~F.isnan("reward"), F.col("reward")))


def derived(spark: SparkSession, d: str) -> DataFrame:
    """Points made of events and embeddings: 45 to 99 points an entity, without gaps in ids."""
    events, pool = table(spark, d, "events"), table(spark, d, "embeddings")
    n = pool.agg(F.count(F.lit(1)).alias("n"))
    keyed = events.select(F.col("event_id").alias("node_id"), F.col("user_id").alias("entity_id"), micros(events, "ts").alias("t"), "event_type", "value").crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("node_id") % F.col("n"))
    return keyed.join(pool.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label"), "vec_id").select("node_id", "entity_id", "t", "vector", "event_type", "value", "label")


def first_invalid(points: DataFrame, order: str, dim: int, vector: str = "vector", t: str = "t", **options) -> DataFrame:
    """The first bad row of a batch by an order column, with its reason; no row if all are valid."""
    return split_valid(points, dim, vector, t, **options)[1].orderBy(order).limit(1)
