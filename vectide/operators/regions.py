"""Regions (nearest hub), their distributions over time, and anchors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from vectide.functions import vectors
from vectide.session import Scratch

MOST_HUBS = 65_536
TILE_ROWS, TILE_HUBS = 512, 2_048


def hubs(points: DataFrame, level: int, m: int = 16) -> DataFrame:
    """hub, hub_vector: the points whose node_id is divisible by m**level, the share of a level of a layered graph."""
    return points.where(F.col("node_id") % (m**level) == 0).select(F.col("node_id").alias("hub"), F.col("vector").alias("hub_vector"))


def assign(points: DataFrame, hub_table: DataFrame) -> DataFrame:
    """points with the nearest hub and its distance (squared L2; those equal to nine digits go to the lower id).

    Hubs travel with the tasks in blocks of at most MOST_HUBS; where a level has more, points meet one block after the
    other and keep the best. A batch meets a block tile by tile, so a task holds one block and one tile. No hub gives no row.
    """
    kept = Scratch(points.sparkSession, "hubs", tidy=True).write(hub_table)  # else each count and block shuffles all points again
    n = kept.count()
    if n <= MOST_HUBS:
        return _nearest_hub(points, kept)
    k = -(-n // (MOST_HUBS // 2))
    found = [_nearest_hub(points.select("node_id", "vector"), kept.where(F.pmod(F.xxhash64("hub"), F.lit(k)) == i)).drop("vector") for i in range(k)]
    every = reduce(DataFrame.unionByName, found)
    best = every.groupBy("node_id").agg(F.min(F.struct(F.floor(F.col("hub_distance") * 1e9 + 0.5), "hub", "hub_distance")).alias("x")).select("node_id", "x.hub", "x.hub_distance")
    return points.join(best, "node_id")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as one matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, n = np.asarray(column.flatten(), float), len(column)
    if n and (flat.size % n or pc.any(pc.not_equal(pc.list_value_length(column), flat.size // n)).as_py()):
        raise ValueError("vectors differ in length")
    return flat.reshape(n, flat.size // max(n, 1))


def _nearest_hub(points: DataFrame, hub_table: DataFrame) -> DataFrame:
    """points with hub, hub_distance over one block of hubs; more than MOST_HUBS are refused."""
    rows = hub_table.select("hub", F.col("hub_vector").cast("array<double>").alias("v")).limit(MOST_HUBS + 1).toArrow()
    if len(rows) > MOST_HUBS:
        raise ValueError(f"a block of hubs holds more than {MOST_HUBS}")
    ids, h = np.asarray(rows["hub"], np.int64), _matrix(rows["v"])
    order = np.argsort(ids, kind="stable")
    if h.size:  # of equal hubs only the lowest id can be the nearest
        order = order[np.sort(np.unique(np.ascontiguousarray(h[order]).view(f"V{h.shape[1] * 8}").ravel(), return_index=True)[1])]
    shared = points.sparkSession.sparkContext.broadcast((ids[order], h[order]))

    def near(batches):
        ids, h = shared.value
        for b in batches:
            if b.num_rows and len(ids):
                at, exact = nearest_rows(_matrix(b.column("vector")), h)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids[at]), pa.array(exact)], names=[*b.schema.names, "hub", "hub_distance"])

    return points.mapInArrow(near, StructType([*points.schema.fields, StructField("hub", LongType()), StructField("hub_distance", DoubleType())]))


def nearest_rows(x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest row of h, the first of those equal to nine digits, and their squared distance.

    Single precision, tile by tile, finds which rows lie within its error of the best; double precision decides among them.
    """
    size = np.sqrt((h * h).sum(1))
    kind = np.float32 if 1e-15 < size.max() < 1e15 and np.abs(x).max(initial=0.0) < 1e15 else np.float64
    # score x.h - h.h / 2 is largest where the distance is least: one product, as x gets a 1 and h its -h.h / 2
    hs = np.concatenate([h, -0.5 * (size * size)[:, None]], 1).astype(kind)
    at, exact = np.empty(len(x), np.int64), np.empty(len(x))
    for lo in range(0, len(x), TILE_ROWS):
        part = x[lo : lo + TILE_ROWS]
        xs = np.concatenate([part, np.ones((len(part), 1))], 1).astype(kind)
        # twice the error of a sum of so many products, and what nine digits of the squared distance leave open
        slack = 2 * (hs.shape[1] + 4) * np.finfo(kind).eps * (np.sqrt((part * part).sum(1)) * size.max() + size.max() ** 2) + 2e-9
        best, digits = np.full(len(part), -np.inf), np.full(len(part), np.inf)
        for k in range(0, len(hs), TILE_HUBS):
            s = xs @ hs[k : k + TILE_HUBS].T
            top = s.max(1)
            best = np.maximum(best, top)
            rows = np.flatnonzero(top >= best - slack)
            r, c = np.nonzero(s[rows] >= (best - slack)[rows, None])
            r, c = rows[r], c + k
            d = np.concatenate([((part[r[i : i + TILE_HUBS]] - h[c[i : i + TILE_HUBS]]) ** 2).sum(1) for i in range(0, len(r), TILE_HUBS)] or [np.zeros(0)])
            nine = np.floor(d * 1e9 + 0.5)
            order = np.lexsort((c, nine, r))
            first = order[np.flatnonzero(np.diff(r[order], prepend=-1))]  # of each row; later tiles have higher ids
            first = first[nine[first] < digits[r[first]]]
            digits[r[first]], at[lo + r[first]], exact[lo + r[first]] = nine[first], c[first], d[first]
    return at, exact


def region_counts(assigned: DataFrame, hub_table: DataFrame) -> DataFrame:
    """hub, n_members; hubs without a member have 0."""
    return hub_table.select("hub").join(assigned.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "hub", "left").select("hub", F.coalesce("n", F.lit(0)).alias("n_members"))


def region_shares(assigned: DataFrame, window_us: int) -> DataFrame:
    """entity_id, win, t (the window's middle), hub, share: tumbling windows from the entity's first point; empty windows are skipped."""
    w = assigned.select("entity_id", "t", "hub").withColumn("t0", F.min("t").over(Window.partitionBy("entity_id"))).withColumn("win", F.floor((F.col("t") - F.col("t0")) / window_us).cast("long"))
    counts = w.groupBy("entity_id", "win", "hub").agg(F.count(F.lit(1)).alias("n"), (F.min("t0") + F.col("win") * window_us + window_us // 2).alias("t"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("entity_id", "win"))).select("entity_id", "win", "t", "hub", "share")


def region_trajectory(assigned: DataFrame, window_us: int, alpha: float) -> DataFrame:
    """region_shares smoothed in time: alpha * share + (1 - alpha) * before, per hub that the entity ever visits; the first window as it is."""
    shares = Scratch(assigned.sparkSession, "shares", tidy=True).write(region_shares(assigned, window_us))  # read three times, found once
    grid = shares.select("entity_id", "win", "t").distinct().join(shares.select("entity_id", "hub").distinct(), "entity_id")
    full = grid.join(shares.select("entity_id", "win", "hub", "share"), ["entity_id", "win", "hub"], "left").select("entity_id", "hub", "win", "t", F.coalesce("share", F.lit(0.0)).alias("share"))
    line = full.groupBy("entity_id", "hub").agg(F.array_sort(F.collect_list(F.struct("win", "t", "share"))).alias("x"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("out"))

    def fold(s: Column, x: Column) -> Column:
        now = F.when(s["last"].isNull(), x["share"]).otherwise(alpha * x["share"] + (1 - alpha) * s["last"])
        return F.struct(now.alias("last"), F.concat(s["out"], F.array(now)).alias("out"))

    smooth = F.aggregate("x", start, fold, lambda s: s["out"])
    return line.select("entity_id", "hub", F.explode(F.arrays_zip(F.col("x").alias("x"), smooth.alias("y"))).alias("z")).select("entity_id", "hub", F.col("z.x.win").alias("win"), F.col("z.x.t").alias("t"), F.col("z.y").alias("share"))


def project_to_anchors(points: DataFrame, anchors: Sequence[Sequence[float]], metric: str = "cosine") -> DataFrame:
    """points with dist, one distance per anchor (cosine distance or true L2); anchors are few and become literals."""
    d = vectors.cosine_distance if metric == "cosine" else vectors.l2
    return points.withColumn("dist", F.array(*[d(F.col("vector"), a) for a in anchors]))


def anchor_summary(projected: DataFrame) -> DataFrame:
    """entity_id, anchor, mean, min, trend (slope against place, not time), last; a point stays one row until its numbers are summed."""
    w = Window.partitionBy("entity_id").orderBy("t", "node_id")
    n = max((len(r["dist"]) for r in projected.select("dist").head(1)), default=0)  # every point has as many anchors
    d = lambda k: F.col("dist")[k]
    placed = projected.select("entity_id", "dist", F.row_number().over(w).alias("i"))
    one = lambda k: F.struct(F.lit(k).alias("anchor"), F.avg(d(k)).alias("mean"), F.min(d(k)).alias("min"), F.coalesce(F.regr_slope(d(k), F.col("i")), F.lit(0.0)).alias("trend"), F.max_by(d(k), "i").alias("last"))
    kinds = F.array(*[one(k) for k in range(n)]) if n else F.array().cast("array<struct<anchor:int,mean:double,min:double,trend:double,last:double>>")
    return placed.groupBy("entity_id").agg(kinds.alias("x")).select("entity_id", F.explode("x").alias("x")).select("entity_id", "x.*")


def centred_summary(points: DataFrame, anchors: Sequence[Sequence[float]], centre: Sequence[float]) -> DataFrame:
    """anchor_summary after subtracting the centre from points and anchors."""
    return anchor_summary(centred_projection(points, anchors, centre))


def anchor_drift(projected: DataFrame, t1: int, t2: int) -> DataFrame:
    """entity_id, delta per anchor, l2, cosine, dominant anchor (of largest absolute change, the last of equals) between the points nearest to two times."""
    near = lambda t, n: projected.groupBy("entity_id").agg(F.min_by("dist", F.struct(F.abs(F.col("t") - t), "t", "node_id")).alias(n))
    d = near(t1, "d1").join(near(t2, "d2"), "entity_id").withColumn("delta", vectors.subtract("d2", "d1"))
    most = F.array_max(F.transform("delta", lambda x, i: F.struct(F.abs(x).alias("a"), i.alias("i"))))
    return d.select("entity_id", "delta", vectors.l2("d1", "d2").alias("l2"), vectors.cosine_distance("d1", "d2").alias("cosine"), most["i"].alias("dominant"))


def centred_projection(points: DataFrame, anchors: Sequence[Sequence[float]], centre: Sequence[float]) -> DataFrame:
    """Cosine distances to anchors after subtracting the centre from points and anchors."""
    moved = [[a - c for a, c in zip(x, centre)] for x in anchors]
    return project_to_anchors(points.withColumn("vector", vectors.subtract("vector", [float(c) for c in centre])), moved)


def members(assigned: DataFrame, hub: int, when: Column | None = None) -> DataFrame:
    """node_id, entity_id, t of one region's points."""
    kept = assigned.where(F.col("hub") == hub)
    return (kept if when is None else kept.where(when)).select("node_id", "entity_id", "t")


def anchor_points(points: DataFrame, anchors: Sequence[Sequence[float]], model: str, metric: str = "cosine") -> DataFrame:
    """Points in anchor space, tagged with the model they came from; the vectors of different models become comparable."""
    p = project_to_anchors(points, anchors, metric)
    return p.withColumn("vector", F.col("dist")).drop("dist").withColumn("source_model", F.lit(model))


def trajectories_by_model(anchored: DataFrame) -> DataFrame:
    """entity_id, source_model, place (from 1, in order of time), t, node_id, vector: each entity's path in anchor space, one per model."""
    w = Window.partitionBy("entity_id", "source_model").orderBy("t", "node_id")
    return anchored.select("entity_id", "source_model", F.row_number().over(w).alias("place"), "t", "node_id", "vector")


def by_model(anchored: DataFrame) -> DataFrame:
    """entity_id, source_model, first_t, last_t, n_points over anchored points of several models."""
    return anchored.groupBy("entity_id", "source_model").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n_points"))
