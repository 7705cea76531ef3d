"""Connected components by hash-to-min.

Every node keeps a cluster of nodes. In each round it sends its whole cluster to the least node in it and that
least node to all the others, until nothing changes; then each node's least neighbour is its component. Clusters
are rows, never collected lists. Nodes with many rows get their minimum by broadcast, and there are at most
HOT_NODES of them, so no key is shuffled to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.session import Scratch

HOT_NODES = 1000


def components(edges: DataFrame, a: str, b: str, scratch: Scratch | None = None) -> DataFrame:
    """node, root (the least node of its component) for every node of an edge.

    Directions, repeats and self edges don't matter; an edge with a null end is ignored; no edge gives no row. The
    result reads a table of scratch.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = ends.select(F.explode(F.array(*[F.struct(F.col(p).alias("node"), F.col(q).alias("member")) for p, q in (("x", "y"), ("y", "x"), ("x", "x"), ("y", "y"))])).alias("e")).select("e.*")
    rows = scratch.write(both.distinct())
    seen = None
    while True:
        n, print_ = rows.agg(F.count(F.lit(1)), F.sum(F.hash("node", "member").cast("long"))).first()
        if (n, print_) == seen or not n:
            break
        seen = (n, print_)
        least = scratch.write(rows.groupBy("node").agg(F.min("member").alias("least"), F.count(F.lit(1)).alias("n")))
        hot = F.broadcast(least.where(F.col("n") > max(20_000, n // HOT_NODES)).select("node", "least"))  # fewer than HOT_NODES rows
        cold = least.where(F.col("n") <= max(20_000, n // HOT_NODES)).select("node", "least")
        known = rows.join(hot, "node", "left")
        joined = known.where("least is not null").unionByName(known.where("least is null").drop("least").join(cold, "node"))
        sent = joined.select(F.explode(F.array(F.struct(F.col("least").alias("node"), F.col("member")), F.struct(F.col("member").alias("node"), F.col("least").alias("member")))).alias("e")).select("e.*")
        following = scratch.write(sent.distinct())
        scratch.drop(rows, least)
        rows = following
    return rows.groupBy("node").agg(F.min("member").alias("root"))
