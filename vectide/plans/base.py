"""The table of queries and their SQL that the catalogue modules fill, and the points that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# the same points in SQL: valid records of ingestpoint, and points made of events and embeddings
ING = """with ing as (select * from ingestpoint qualify row_number() over (partition by sequence order by node_id) = 1),
pts as (select node_id, entity_id, t, vector::double[] as vector, case when isnan(reward) then null else reward end as reward, metadata from ing
 where vector is not null and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
qv as (select vector as q from anchors where anchor_idx = 0),
d as (select pts.*, list_sum(list_transform(list_zip(vector, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d2 from pts, qv)
"""
PTS = """with pts as (select e.event_id as node_id, e.user_id as entity_id, epoch_us(e.ts) as t, v.embedding::double[] as vector, e.event_type, e.value, v.label
 from events e join embeddings v on e.event_id % (select count(*) from embeddings) = v.vec_id)
"""
