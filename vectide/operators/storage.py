"""Delta encoding, product quantisation and point stores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions import vectors


def delta_encode(points: DataFrame, every: int = 10, epsilon: float = 0.0) -> DataFrame:
    """entity_id, node_id, t, seq, keyframe, base_t, indices, values: every so many points a whole vector, else the components that moved by more than epsilon."""
    w = Window.partitionBy("entity_id").orderBy("t", "node_id")
    p = points.select("entity_id", "node_id", "t", "vector", (F.row_number().over(w) - 1).alias("seq"), F.lag("vector").over(w).alias("v0"), F.lag("t").over(w).alias("base_t"))
    moved = F.filter(F.transform("vector", lambda x, i: F.struct(i.alias("i"), (x - F.col("v0")[i]).alias("d"))), lambda s: F.abs(s["d"]) > epsilon)
    key = F.col("seq") % every == 0
    p = p.withColumn("keyframe", key).withColumn("m", F.when(~key, moved))
    return p.select("entity_id", "node_id", "t", "seq", "keyframe", "base_t", F.when(F.col("keyframe"), F.transform("vector", lambda x, i: i)).otherwise(F.transform("m", lambda s: s["i"])).alias("indices"), F.when(F.col("keyframe"), F.col("vector")).otherwise(F.transform("m", lambda s: s["d"])).alias("values"))


def delta_decode(encoded: DataFrame, every: int, dim: int) -> DataFrame:
    """entity_id, node_id, t, vector: within a run from keyframe to keyframe (at most every points) the changes add up."""
    run = encoded.withColumn("run", F.floor(F.col("seq") / every))
    w = Window.partitionBy("entity_id", "run", "dim").orderBy("seq")
    long = run.select("entity_id", "run", "seq", "node_id", "t", F.map_from_arrays("indices", "values").alias("m")).select("entity_id", "run", "seq", "node_id", "t", "m", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("dim"))
    summed = long.withColumn("x", F.sum(F.coalesce(F.try_element_at("m", F.col("dim")), F.lit(0.0))).over(w))
    return summed.groupBy("entity_id", "node_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vector"))


def compression(encoded: DataFrame, dim: int) -> DataFrame:
    """One row: bytes of whole vectors over bytes of the encoding (4 a value, 4 an index)."""
    return encoded.agg((F.count(F.lit(1)) * 4 * dim / F.sum(F.when(F.col("keyframe"), 4 * dim).otherwise(8 * F.size("indices")))).alias("ratio"))


class Codebook:
    """Product quantisation: subspaces with their centres, trained on a bounded sample."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres  # subspace, code, component

    @classmethod
    def train(cls, points: DataFrame, m: int, k: int, rounds: int = 10, seed: int = 42, sample: int = 50_000) -> Codebook:
        """k-means with spread-out starts in each of m subspaces, on at most sample vectors chosen by hash (whole vectors; every vector is encoded afterwards)."""
        n = points.count()
        some = points.where(F.pmod(F.xxhash64("node_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))).orderBy("node_id").limit(2 * sample).select("vector").toArrow()
        x = np.stack(some["vector"].to_numpy()).astype(float)
        width = x.shape[1] // m
        out = []
        for s in range(m):
            part, rng = x[:, s * width : (s + 1) * width], np.random.default_rng(seed + s)
            c = [part[rng.integers(len(part))]]
            d = ((part - c[0]) ** 2).sum(1)
            while len(c) < k:
                pick = rng.choice(len(part), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(part))
                c.append(part[pick])
                d = np.minimum(d, ((part - c[-1]) ** 2).sum(1))
            c = np.array(c)
            for _ in range(rounds):
                at = ((part * part).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * part @ c.T).argmin(1)
                n_at = np.bincount(at, minlength=k)
                sums = np.zeros_like(c)
                np.add.at(sums, at, part)
                c = np.where(n_at[:, None] > 0, sums / np.maximum(n_at, 1)[:, None], c)
            out.append(c)
        return cls(np.array(out))

    def encode(self, points: DataFrame) -> DataFrame:
        """points with codes, one number per subspace."""
        centres = self.centres

        @F.pandas_udf("array<int>")
        def codes(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()).astype(float).reshape(len(v), centres.shape[0], -1)
            d = np.stack([((x[:, s][:, None] - centres[s][None]) ** 2).sum(-1).argmin(1) for s in range(len(centres))], 1)
            return pd.Series(list(d.astype(np.int32)))

        return points.withColumn("codes", codes("vector"))

    def decode(self, codes: Column) -> Column:
        """The centres of an array of codes, in the JVM."""
        table = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in sub]) for sub in self.centres])
        return F.flatten(F.transform(codes, lambda c, i: table[i][c]))

    def distance(self, codes: Column, query: np.ndarray) -> Column:
        """Squared distance of coded vectors to a query, looked up in one table of subspaces by codes."""
        q = np.asarray(query, float).reshape(len(self.centres), 1, -1)
        rows = ((self.centres - q) ** 2).sum(-1)
        table = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])
        return F.aggregate(F.transform(codes, lambda c, i: table[i][c]), F.lit(0.0), lambda s, x: s + x)

    def search(self, points: DataFrame, query: np.ndarray, k: int, share: float = 0.05) -> DataFrame:
        """The k nearest points (score: squared distance, ties by node_id) among the share of them that the codes put nearest, at least 10 k.

        The pool grows with the points, so that its recall doesn't fall with their number; it is found by a quantile, not collected.
        """
        share = min(1.0, max(share, 10 * k / max(points.count(), 1)))
        coded = self.encode(points).withColumn("coarse", self.distance(F.col("codes"), query))
        bound = coded.agg(F.percentile_approx("coarse", share, 10000)).first()[0]
        pool = coded.where(F.col("coarse") <= F.lit(bound)).drop("codes", "coarse")
        return pool.withColumn("score", vectors.l2_squared(F.col("vector"), [float(x) for x in query])).orderBy("score", "node_id").limit(k)


def put(store: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The store with new rows in place of old ones of the same key; of equal new keys the one with the largest remaining columns stays."""
    rest = [c for c in store.columns if c not in key]
    both = store.withColumn("__n", F.lit(0)).unionByName(new.select(*store.columns).withColumn("__n", F.lit(1)))
    return both.groupBy(*key).agg(F.max(F.struct("__n", *rest)).alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in rest]).select(*store.columns)


def delete(store: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return store.join(keys.select(*key).distinct(), key, "left_anti")


def write_points(points: DataFrame, path: str, bucket_us: int = 7 * 86_400_000_000) -> None:
    """Parquet partitioned by time bucket and sorted by entity and time within files, so that both kinds of filter skip data; floors negative times."""
    b = points.withColumn("bucket", F.expr(f"(t - pmod(t, {bucket_us}L)) div {bucket_us}L"))
    b.repartition("bucket", F.pmod(F.xxhash64("entity_id"), F.lit(8))).sortWithinPartitions("bucket", "entity_id", "t").write.mode("append").partitionBy("bucket").option("parquet.bloom.filter.enabled#entity_id", "true").parquet(path)


def read_range(spark, path: str, start: int, end: int, bucket_us: int = 7 * 86_400_000_000) -> DataFrame:
    """Points in a closed time range; only the buckets that it touches are listed and read."""
    return spark.read.parquet(path).where(F.col("bucket").between(start // bucket_us, end // bucket_us) & F.col("t").between(start, end))
