"""Drift of a cohort between two times, counterfactual continuation, Procrustes alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors
from vectide.operators.trajectory import nearest_in_time


def _moves(points: DataFrame, t1: int, t2: int) -> DataFrame:
    both = nearest_in_time(points, t1, "v1").select("entity_id", "v1").join(nearest_in_time(points, t2, "v2").select("entity_id", "v2"), "entity_id")
    return both.withColumn("move", vectors.subtract("v2", "v1")).withColumn("drift", vectors.l2("v1", "v2"))


def _mean(df: DataFrame, col: str) -> DataFrame:
    m = df.select(F.posexplode(col).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"))
    return F.broadcast(m.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias(f"mean_{col}")))  # one row, one element a dimension


def cohort_drift(points: DataFrame, t1: int, t2: int, top_n: int = 5) -> DataFrame:
    """One row over all entities of points: counts, drift statistics, centroid drift, dispersions, convergence, top dimensions.

    Fewer than two entities give no row. Convergence is the mean cosine of the moves with the mean move, of non-zero
    moves; 0 if fewer than two or no mean move.
    """
    m = _moves(points, t1, t2)
    m = m.crossJoin(_mean(m, "v1")).crossJoin(_mean(m, "v2")).crossJoin(_mean(m, "move"))
    size, mean = vectors.norm("move"), vectors.norm("mean_move")
    along = F.when((size > 1e-12) & (mean > 1e-12), vectors.dot("move", "mean_move") / F.nullif(size * mean, F.lit(0.0)))
    s = m.agg(
        F.count(F.lit(1)).alias("n_entities"), F.avg("drift").alias("mean_drift"), F.percentile("drift", 0.5).alias("median_drift"), F.stddev_samp("drift").alias("std_drift"),
        F.first(vectors.l2("mean_v1", "mean_v2")).alias("centroid_l2"), F.first(vectors.cosine_distance("mean_v1", "mean_v2")).alias("centroid_cosine"),
        F.avg(vectors.l2("v1", "mean_v1")).alias("dispersion_t1"), F.avg(vectors.l2("v2", "mean_v2")).alias("dispersion_t2"), F.count(along).alias("moving"), F.avg(along).alias("along"), F.first(vectors.top_dims(F.col("mean_move"), top_n)).alias("top"),
    ).where("n_entities >= 2")
    return s.select("n_entities", "mean_drift", "median_drift", "std_drift", "centroid_l2", "centroid_cosine", "dispersion_t1", "dispersion_t2", (F.col("dispersion_t2") - F.col("dispersion_t1")).alias("dispersion_change"), F.when(F.col("moving") >= 2, F.col("along")).otherwise(0.0).alias("convergence"), "top")


def cohort_outliers(points: DataFrame, t1: int, t2: int, z: float = 2.0) -> DataFrame:
    """entity_id, drift, z_score, alignment of entities whose drift is more than z deviations from the mean."""
    m = _moves(points, t1, t2)
    s = F.broadcast(m.agg(F.avg("drift").alias("mu"), F.stddev_samp("drift").alias("sd")))  # one row
    m = m.crossJoin(s).crossJoin(_mean(m, "move"))
    score = F.when(F.col("sd") > 1e-12, (F.col("drift") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0))).otherwise(0.0)
    return m.select("entity_id", "drift", score.alias("z_score"), (1 - vectors.cosine_distance("move", "mean_move")).alias("alignment")).where(F.abs("z_score") > z)


def counterfactual(points: DataFrame, at: int) -> DataFrame:
    """Per entity and point from at on: t, divergence from the line through its points up to at (a point exactly there is in both).

    Times are centred on at before the fit, else their squares leave no digit. One point before gives a constant line.
    """
    x = (F.col("t") - at) / 86_400_000_000.0
    long = points.select("entity_id", "t", x.alias("x"), F.posexplode("vector").alias("dim", "y"))
    line = long.where(F.col("t") <= at).groupBy("entity_id", "dim").agg(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.avg("y").alias("ym"), F.avg("x").alias("xm"))
    post = long.where(F.col("t") >= at).join(line, ["entity_id", "dim"])
    gap = F.col("y") - (F.col("ym") + F.col("slope") * (F.col("x") - F.col("xm")))
    return post.groupBy("entity_id", "t").agg(F.sqrt(F.sum(gap * gap)).alias("divergence"))


def counterfactual_summary(points: DataFrame, at: int) -> DataFrame:
    """entity_id, total_divergence (area under the curve, day units), max_divergence, max_t (the last of equals)."""
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id").orderBy("t")
    c = counterfactual(points, at).withColumn("area", (F.col("divergence") + F.lag("divergence").over(w)) / 2 * (F.col("t") - F.lag("t").over(w)) / 86_400_000_000.0)
    return c.groupBy("entity_id").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("total_divergence"), F.max("divergence").alias("max_divergence"), F.max_by("t", F.struct("divergence", "t")).alias("max_t"))


def fit_procrustes(pairs: DataFrame, source: str, target: str, dim: int) -> dict | None:
    """Rotation, scale and means that carry source vectors onto target ones, from one pass of cross sums (dim x dim numbers come back); None for no pair."""
    row = pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull())

    def part(batches):
        import pyarrow as pa

        n, sx, sy, xy, xx, yy = 0, np.zeros(dim), np.zeros(dim), np.zeros((dim, dim)), 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x, y = np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(float), np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float)
                n, sx, sy, xy, xx, yy = n + len(x), sx + x.sum(0), sy + y.sum(0), xy + x.T @ y, xx + (x * x).sum(), yy + (y * y).sum()
        flat = np.concatenate([[n, xx, yy], sx, sy, xy.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "s"])

    sums = row.select(source, target).mapInArrow(part, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas().sort_values("i")["s"].to_numpy()
    if not len(sums) or not sums[0]:
        return None
    n, mx, my = sums[0], sums[3 : 3 + dim] / sums[0], sums[3 + dim : 3 + 2 * dim] / sums[0]
    cross = sums[3 + 2 * dim :].reshape(dim, dim) - n * np.outer(mx, my)
    u, s, vt = np.linalg.svd(cross)
    vx, vy = sums[1] - n * mx @ mx, sums[2] - n * my @ my
    scale = float(s.sum() / vx) if vx > 1e-15 else 1.0
    return {"rotation": u @ vt, "scale": scale, "mean_source": mx, "mean_target": my, "error": float(np.sqrt(max(0.0, vy - s.sum() * scale)) / n)}


def apply_procrustes(points: DataFrame, vector: str, fit: dict, out: str = "aligned") -> DataFrame:
    """points with the transformed vector as a new column, one matrix product per batch."""
    @F.pandas_udf("array<double>")
    def carry(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        return pd.Series(list(fit["scale"] * (x - fit["mean_source"]) @ fit["rotation"] + fit["mean_target"]))

    return points.withColumn(out, carry(vector))
