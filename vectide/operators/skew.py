"""Per-key results when a few keys hold most rows.

Rows are range-partitioned on (key, time, id) with Spark's sampled quantiles, so a heavy key is split over as
many partitions as its share deserves. Each sorted partition is folded into one state per key; a key that
touches a partition's edge leaves a partial state, and the partial states of neighbouring partitions are
stitched in order. Only states are shuffled again: at most one per key and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.session import width

NO_TIME = -(2**63)
STATE = "k string, part int, n long, first_us long, last_us long, n_value long, sum_value double, max_gap_us long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of the keys of one sorted partition; the last key of a batch is carried into the next."""
    part = TaskContext.get().partitionId()
    names = ["k", "part", "n", "first_us", "last_us", "n_value", "sum_value", "max_gap_us"]
    carry: list | None = None

    def merge(a: list, b: list) -> list:
        gap = b[2] - a[3] if a[3] != NO_TIME and b[2] != NO_TIME else 0
        return [a[0], a[1] + b[1], a[2] if a[2] != NO_TIME else b[2], b[3] if b[3] != NO_TIME else a[3], a[4] + b[4], a[5] + b[5], max(a[6], b[6], gap)]

    def emit(states: list[list]) -> pa.RecordBatch:
        k, n, first, last, nv, sv, gap = (list(x) for x in zip(*states))
        none = lambda xs: [None if x == NO_TIME else x for x in xs]
        cols = [pa.array(k, pa.string()), pa.array([part] * len(k), pa.int32()), pa.array(n, pa.int64()), pa.array(none(first), pa.int64()), pa.array(none(last), pa.int64()), pa.array(nv, pa.int64()), pa.array(sv, pa.float64()), pa.array(gap, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        codes = keys.dictionary_encode()
        c = codes.indices.to_numpy(zero_copy_only=False)
        t = batch.column(1).to_numpy(zero_copy_only=False)
        v = batch.column(2).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        timed = t != NO_TIME
        n = np.diff(np.r_[start, len(c)])
        end = start + n - 1
        # nulls of time sort first, so the last row has the latest time and the first timed row follows the nulls
        untimed = np.add.reduceat((~timed).astype(np.int64), start)
        first = np.where(untimed < n, t[np.minimum(start + untimed, len(t) - 1)], NO_TIME)
        has = ~np.isnan(v)
        nv = np.add.reduceat(has.astype(np.int64), start)
        sv = np.add.reduceat(np.where(has, v, 0.0), start)
        step = np.zeros(len(t), np.int64)
        inner = np.r_[False, (c[1:] == c[:-1]) & timed[:-1] & timed[1:]]
        step[inner] = t[inner] - t[np.flatnonzero(inner) - 1]
        gap = np.maximum.reduceat(step, start)
        words = codes.dictionary.to_pylist()
        states = [[words[c[s]], int(a), int(f), int(t[e]), int(b), float(x), int(g)] for s, e, a, f, b, x, g in zip(start, end, n, first, nv, sv, gap)]
        if carry is not None:
            if carry[0] == states[0][0]:
                states[0] = merge(carry, states[0])
            else:
                states.insert(0, carry)
        carry = states.pop()
        if states:
            yield emit(states)
    if carry is not None:
        yield emit([carry])


def key_stats(rows: DataFrame, key: str, ts_us: str, unique: str, value: str) -> DataFrame:
    """Per key: n_rows, first_us, last_us, mean_value (of non-null values), max_gap_us (longest wait between neighbours).

    Rows with a null key are left out; rows with the same non-null unique value count once, all others count; a
    null time counts as a row but has no part in times and gaps; a NaN value counts as null; an empty input
    gives no row. Other columns are ignored, whatever their names.
    """
    r = rows.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("k"), F.coalesce(F.col(ts_us).cast("long"), F.lit(NO_TIME)).alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("v"), F.col(unique).alias("u")
    )
    # copies of one row are merged by a partial aggregate first: a group of copies can't be split by range
    once = r.where("u is not null").groupBy("u").agg(F.min(F.struct("k", "t", "v")).alias("r")).select("r.k", "r.t", "r.v", "u").unionByName(r.where("u is null").select("k", "t", "v", "u"))
    salt = F.xxhash64("u", "v")  # splits a key even where all its times are equal
    spread = once.withColumn("s", salt).repartitionByRange(width(rows.sparkSession), "k", "t", "s").sortWithinPartitions("k", "t", "s").select("k", "t", "v")
    states = spread.mapInArrow(_fold, STATE)
    w = Window.partitionBy("k").orderBy("part")
    stitched = states.withColumn("seam_us", F.col("first_us") - F.lag("last_us", 1).over(w))
    return stitched.groupBy("k").agg(
        F.sum("n").alias("n_rows"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.try_divide(F.sum("sum_value"), F.sum("n_value")).alias("mean_value"), F.greatest(F.max("max_gap_us"), F.coalesce(F.max("seam_us"), F.lit(0))).alias("max_gap_us")
    ).withColumnRenamed("k", key)

HOT_KEYS = 1000


def hot_join(rows: DataFrame, lookup: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with lookup, a table of one row per key whose column n counts the rows of that key.

    Keys with more than a HOT_KEYS-th of total rows are fewer than HOT_KEYS, so their part of lookup is broadcast;
    all other keys meet in an ordinary shuffled join. n is dropped from the result.
    """
    limit = max(20_000, total // HOT_KEYS)
    hot = F.broadcast(lookup.where(F.col(n) > limit).drop(n).withColumn("__hot", F.lit(True)))
    known = rows.join(hot, key, "left")
    names = [c for c in lookup.columns if c not in (key, n)]
    cold = known.where("__hot is null").drop("__hot", *names).join(lookup.where(F.col(n) <= limit).drop(n), key, how)
    return known.where("__hot").drop("__hot").unionByName(cold)
