"""Sessions by pointer doubling.

Any two events of one key within one time bucket as wide as the gap belong together, so events are first
collapsed to one node per (key, bucket) with a partial aggregate: a key that holds a third of all rows costs no
more than its number of buckets, and those are spread over all tasks. A node's predecessor can only be the
bucket before. Linked nodes then double their pointers by self-joins until every pointer reaches a root, and
nodes are aggregated by root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.session import Scratch


def sessionize(events: DataFrame, key: str, ts_us: str, gap_us: int, unique: str | None = None) -> DataFrame:
    """One row per session: key, start_us, end_us, duration_us, n_events.

    events: any columns beside the named ones are ignored. Rows with a null key or time are left out; an empty
    input gives no session; equal times share a session. unique: rows with the same value count once (rows
    whose value is null all count). An event more than gap_us after the key's previous one starts a session,
    one exactly gap_us after it does not. gap_us must be at least 1.
    """
    if gap_us < 1:
        raise ValueError("gap_us must be at least 1")
    kept = events.where(F.col(key).isNotNull() & F.col(ts_us).isNotNull()).select(
        F.col(key).alias("k"), F.col(ts_us).cast("long").alias("t"), *([F.col(unique).alias("u")] if unique else [])
    )
    if unique:
        # min_by over the whole row would be as good: duplicates agree on key and time; the least time is the defined choice if not
        kept = kept.where("u is not null").groupBy("u").agg(F.min(F.struct("t", "k")).alias("r")).select("r.k", "r.t").unionByName(kept.where("u is null").select("k", "t"))
    bucket = F.expr(f"(t - pmod(t, {gap_us}L)) div {gap_us}L")
    scratch = Scratch(events.sparkSession, "sessions")
    nodes = scratch.write(kept.groupBy("k", bucket.alias("b")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n")))
    before = nodes.select("k", (F.col("b") + 1).alias("b"), F.col("hi").alias("before"))
    links = scratch.write(nodes.join(before, ["k", "b"]).where(F.col("lo") - F.col("before") <= gap_us).select("k", "b", (F.col("b") - 1).alias("p")))
    while True:
        target = links.select("k", F.col("b").alias("p"), F.col("p").alias("pp"))
        hop = links.join(target, ["k", "p"], "left")
        doubled = scratch.write(hop.select("k", "b", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
        moved = doubled.where("moved").limit(1).count()
        scratch.drop(links)
        links = doubled.drop("moved")
        links.scratch_path = doubled.scratch_path
        if not moved:
            break
    rooted = nodes.join(links, ["k", "b"], "left").select("k", F.coalesce("p", "b").alias("root"), "lo", "hi", "n")
    return rooted.groupBy("k", "root").agg(F.min("lo").alias("start_us"), F.max("hi").alias("end_us"), F.sum("n").alias("n_events")).select(
        F.col("k").alias(key), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events"
    )
