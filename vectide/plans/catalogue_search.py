"""Searches, filters, ingestion, regions and anchors on ingestpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import episodes, scoring, vectors
from vectide.functions.filters import MetadataFilter, TemporalFilter
from vectide.operators import lsh, regions, search
from vectide.operators.joins import tier_compact, tier_union
from vectide.operators.search import SearchSpec
from vectide.plans.base import ING, query
from vectide.session import table
from vectide.sources import points as pts

MID = 1235000000000000
MOST_ANCHORS = 1000  # anchors become literals; the table is fixed and has ten
LOW, HIGH = 1232000000000000, 1238000000000000


def _q(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "anchors").where("anchor_idx = 0").first()["vector"]]


def _anchors(spark: SparkSession, d: str) -> list[list[float]]:
    rows = table(spark, d, "anchors").orderBy("anchor_idx").limit(MOST_ANCHORS + 1).collect()
    if len(rows) > MOST_ANCHORS:
        raise ValueError(f"at most {MOST_ANCHORS} anchors")
    return [[float(x) for x in r["vector"]] for r in rows]


def _out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("node_id", "entity_id", F.round("score", 6).alias("score"), *more)


def _sql(score: str = "d2", where: str = "true", k: int = 10, pool: str = "d") -> str:
    return f"{ING} select node_id, entity_id, round({score}, 6) as score from {pool} where {where} order by {score}, node_id limit {k}"


@query(f"{ING} select node_id, entity_id, round(d2, 6) as score from d where t = (select min(t) from pts where entity_id = 1) order by d2, node_id limit 10")
def snapshot_knn(spark, d):
    p = pts.ingested(spark, d)
    t = p.where("entity_id = 1").agg(F.min("t")).first()[0] or 0
    return _out(search.nearest(p, SearchSpec(_q(spark, d), when=TemporalFilter.snapshot(t))))


@query(_sql(where=f"t between {LOW} and {HIGH}"))
def range_knn(spark, d):
    return _out(search.nearest(pts.ingested(spark, d), SearchSpec(_q(spark, d), when=TemporalFilter.between(LOW, HIGH))))


SPAN = "(select greatest(max(t) - min(t), 1) from pts)"
TD = f"least(abs(t - {MID}) / {SPAN}, 1.0)"
ALPHA = f"(0.7 * least(d2 / 2, 1.0) + 0.3 * {TD})"


@query(_sql(ALPHA, where=f"t between {LOW} and {HIGH}"))
def range_knn_alpha(spark, d):
    return _out(search.nearest(pts.ingested(spark, d), SearchSpec(_q(spark, d), when=TemporalFilter.between(LOW, HIGH), alpha=0.7, query_t=MID)))


@query(f"{ING}, pool as (select * from d order by d2, node_id limit 40) select node_id, entity_id, round({ALPHA}, 6) as score from pool order by {ALPHA}, node_id limit 10")
def knn_two_stage(spark, d):
    return _out(search.nearest(pts.ingested(spark, d), SearchSpec(_q(spark, d), alpha=0.7, query_t=MID, candidate_pool=40)))


COS = "(1 - greatest(-1, least(1, list_inner_product(vector, q) / (sqrt(list_inner_product(vector, vector)) * sqrt(list_inner_product(q, q))))))"


@query(f"{ING} select node_id, entity_id, round({COS}, 6) as score from pts, qv order by {COS}, node_id limit 10")
def knn_cosine(spark, d):
    return _out(search.nearest(pts.ingested(spark, d), SearchSpec(_q(spark, d), metric="cosine")))


@query(f"{ING} select node_id, entity_id, round(-list_inner_product(vector, q), 6) as score from pts, qv order by -list_inner_product(vector, q), node_id limit 10")
def knn_dot(spark, d):
    return _out(search.nearest(pts.ingested(spark, d), SearchSpec(_q(spark, d), metric="dot")))


REC = f"(0.8 * least(d2 / 2, 1.0) + 0.2 * {TD} + 0.5 * (1 - exp(-2.0 * ((select max(t) from pts) - t) / {SPAN})))"


@query(_sql(REC))
def knn_recency(spark, d):
    return _out(search.nearest(pts.ingested(spark, d), SearchSpec(_q(spark, d), alpha=0.8, query_t=MID, recency_rate=2.0, recency_weight=0.5)))


@query(_sql(where="reward >= 0.8"))
def knn_reward(spark, d):
    return _out(search.nearest(pts.ingested(spark, d), SearchSpec(_q(spark, d), min_reward=0.8)))


@query(_sql(where="metadata['model'] = 'mental-small' and coalesce(try_cast(metadata['value'] as double) >= 1.0, false)"))
def knn_metadata(spark, d):
    return _out(search.nearest(pts.ingested(spark, d), SearchSpec(_q(spark, d), metadata=MetadataFilter().equals("model", "mental-small").gte("value", 1.0))))


def _meta(name: str, f: MetadataFilter, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return pts.ingested(spark, d).where(f.column()).select("node_id")

    run.__name__ = name
    query(f"{ING} select node_id from pts where coalesce({sql}, false)")(run)


_meta("metadata_equals", MetadataFilter().equals("model", "forum-base"), "metadata['model'] = 'forum-base'")
_meta("metadata_contains", MetadataFilter().contains("model", "small"), "contains(metadata['model'], 'small')")
_meta("metadata_gte", MetadataFilter().gte("value", 2.0), "try_cast(metadata['value'] as double) >= 2.0")
_meta("metadata_lte", MetadataFilter().lte("value", 50.0), "try_cast(metadata['value'] as double) <= 50.0")
_meta("metadata_exists", MetadataFilter().exists("value"), "len(list_filter(map_keys(metadata), lambda x: x = 'value')) > 0")


def _time(name: str, f: TemporalFilter, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return pts.ingested(spark, d).where(f.column()).select("node_id", "t")

    run.__name__ = name
    query(f"{ING} select node_id, t from pts where {sql}")(run)


_time("filter_before", TemporalFilter.before(MID), f"t <= {MID}")
_time("filter_after", TemporalFilter.after(MID), f"t >= {MID}")
_time("filter_range", TemporalFilter.between(LOW, HIGH), f"t between {LOW} and {HIGH}")

SUCC = "s as (select source as node_id, (1 + sum(case when edge_type = 'causal_success' then weight else 0 end)) / (2 + sum(case when edge_type in ('causal_success', 'causal_failure') then weight else 0 end)) as succ, sum(case when edge_type in ('causal_success', 'causal_failure') then weight else 0 end) as w from typed_edges where source is not null group by 1)"
SCORE = f"(least(d2 / 2, 1.0) + 0.3 * (1 - exp(-1.0 * ((select max(t) from pts) - t) / {SPAN})) + 0.5 * coalesce(1 - reward, 0.5) + 0.4 * (1 - coalesce(case when w < 0.01 then 0.5 else succ end, 0.5)) + 0.2 * case when node_id % 2 = 0 then 0.0 else 1.0 end)"


@query(f"{ING}, {SUCC}, pool as (select * from d order by d2, node_id limit 40) select pool.node_id, entity_id, round({SCORE.replace('node_id %', 'pool.node_id %')}, 6) as score from pool left join s on s.node_id = pool.entity_id order by {SCORE.replace('node_id %', 'pool.node_id %')}, pool.node_id limit 10")
def scored_search(spark, d):
    from vectide.operators.graph import success_scores

    p = pts.ingested(spark, d)
    by_entity = success_scores(table(spark, d, "typed_edges")).withColumnRenamed("source", "entity_id")
    return _out(search.scored_search(p, SearchSpec(_q(spark, d)), scoring.BALANCED, by_entity, F.col("node_id") % 2 == 0, "entity_id"))


LINE = "line as (select node_id, entity_id, t, row_number() over (partition by entity_id order by t, node_id) as pos, lag(node_id) over (partition by entity_id order by t, node_id) as before, lead(node_id) over (partition by entity_id order by t, node_id) as after from pts)"


@query(f"""{ING}, {LINE}, hit as (select node_id, d2 from d order by d2, node_id limit 5)
select h.node_id, round(h.d2, 6) as score, a.entity_id, b.pos - a.pos as offset, b.node_id as other_id, b.t as other_t
from hit h join line a on a.node_id = h.node_id join line b on b.entity_id = a.entity_id and b.pos <> a.pos and abs(b.pos - a.pos) <= 3""")
def causal_search(spark, d):
    out = search.causal_search(pts.ingested(spark, d), SearchSpec(_q(spark, d), 5), 3)
    return out.withColumn("score", F.round("score", 6)).withColumn("offset", F.col("offset").cast("long"))


HYB = f"(0.6 * d2 + 0.4 * {TD})"


@query(f"""{ING}, {LINE}, hit as (select node_id from d order by d2, node_id limit 10),
near as (select node_id from hit union select before from line join hit using (node_id) union select after from line join hit using (node_id))
select node_id, entity_id, round({HYB}, 6) as score from d where node_id in (select node_id from near where node_id is not null) order by {HYB}, node_id limit 10""")
def hybrid_search(spark, d):
    return _out(search.hybrid_search(pts.ingested(spark, d), SearchSpec(_q(spark, d), alpha=0.6, query_t=MID)))


@query("with ing as" + ING.split("with ing as", 1)[1] + ", b as (select a.anchor_idx as query, node_id, list_sum(list_transform(list_zip(pts.vector, a.vector), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as s from pts, anchors a) select query, node_id, round(s, 6) as score from b qualify row_number() over (partition by query order by s, node_id) <= 5")
def batch_knn(spark, d):
    return search.batch_nearest(pts.ingested(spark, d), _anchors(spark, d), 5).withColumn("score", F.round("score", 6))


@query(f"{ING} select i - 1 as dim, round(avg(vector[i]), 6) as mean from pts, range(1, 65) r(i) group by i")
def centroid(spark, d):
    return search.centroid(pts.ingested(spark, d)).select(F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


@query(f"""{ING}, m as (select list(m order by i) as c from (select i, avg(vector[i]) as m from pts, range(1, 65) r(i) group by i)),
e as (select pts.*, list_sum(list_transform(list_zip(vector, c, q), lambda z: (z[1] - z[2] - z[3]) * (z[1] - z[2] - z[3]))) as d3 from pts, m, qv)
select node_id, entity_id, round(d3, 6) as score from e order by d3, node_id limit 10""")
def centred_knn(spark, d):
    p = pts.ingested(spark, d)
    c = search.centroid_vector(p)
    moved = p.crossJoin(F.broadcast(c)).withColumn("vector", vectors.subtract("vector", "centroid"))
    return _out(search.nearest(moved, SearchSpec(_q(spark, d))))


@query(f"{ING} select node_id, entity_id, round(d2 / greatest(exp(-3.0 * greatest({HIGH} - t, 0) / 1e12), 1e-10), 6) as score from d where exp(-3.0 * greatest({HIGH} - t, 0) / 1e12) > 1e-10 order by d2 / exp(-3.0 * greatest({HIGH} - t, 0) / 1e12), node_id limit 10")
def decayed_knn(spark, d):
    w = scoring.decay_weight(F.col("t"), HIGH, 3.0 / 1e12)
    p = pts.ingested(spark, d).withColumn("score", scoring.decayed_distance(vectors.l2_squared("vector", _q(spark, d)), w)).where(w > 1e-10)
    return _out(p.orderBy("score", "node_id").limit(10))


@query()
def lsh_search(spark, d):
    p, cfg = pts.ingested(spark, d), lsh.LshConfig(tables=16, bits=6, bucket_us=30 * lsh.DAY_US, time_probes=2, flips=6)
    return _out(lsh.search(p, lsh.build(p, 64, cfg), _q(spark, d), MID, 10, cfg))


@query(f"{ING}, b as (select a.anchor_idx as query, node_id, list_sum(list_transform(list_zip(pts.vector, a.vector), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as s, list_sum(list_transform(list_zip(pts.vector[1:48], a.vector[1:48]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as h from pts, anchors a), x as (select query, node_id from b qualify row_number() over (partition by query order by s, node_id) <= 10), y as (select query, node_id from b qualify row_number() over (partition by query order by h, node_id) <= 10) select round((select count(*) from x join y using (query, node_id)) / (select count(*) from x)::double, 6) as recall")
def recall_of_batch(spark, d):
    """Recall@10 of a search that looks at 48 of 64 components only, over the anchors."""
    p, a = pts.ingested(spark, d), _anchors(spark, d)
    half = search.batch_nearest(p.withColumn("vector", F.slice("vector", 1, 48)), [x[:48] for x in a], 10)
    return search.recall(half, search.batch_nearest(p, a, 10), ["query", "node_id"]).withColumn("recall", F.round("recall", 6))


@query("""select node_id, case when vector is null or len(vector) = 0 then 'empty_vector' when len(vector) <> 64 then 'wrong_dimension' when t is null or t < 1231000000000000 then 'timestamp_out_of_range'
when len(list_filter(vector, lambda x: x is null or isnan(x))) > 0 then 'nan' when len(list_filter(vector, lambda x: isinf(x))) > 0 then 'infinite' when len(list_filter(vector, lambda x: x <> 0)) = 0 then 'zero_vector' end as reason
from ingestpoint where vector is null or len(vector) <> 64 or t is null or t < 1231000000000000 or len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) > 0 or len(list_filter(vector, lambda x: x <> 0)) = 0""")
def validate_quarantine(spark, d):
    _, bad = pts.split_valid(table(spark, d, "ingestpoint"), 64, t_min=1231000000000000)
    return bad.select("node_id", "reason")


@query("select sequence, min(node_id) as node_id, min(entity_id) as entity_id from ingestpoint group by sequence")
def dedup_first(spark, d):
    return pts.latest(table(spark, d, "ingestpoint").select("sequence", "node_id", "entity_id"), ["sequence"], [F.col("node_id")])


@query("""with h as (select entity_id, t, min(sequence) as s from ingestpoint where t > 1235000000000000 group by 1, 2), w as (select entity_id, t, min(sequence) as s from ingestpoint where t <= 1236000000000000 group by 1, 2)
select entity_id, t, coalesce(h.s, w.s) as s, case when h.s is not null then 'hot' else 'warm' end as tier from h full join w using (entity_id, t)""")
def tiers_union(spark, d):
    p = table(spark, d, "ingestpoint").groupBy("entity_id", "t").agg(F.min("sequence").alias("s"))
    return tier_union(p.where(f"t > {MID}"), p.where("t <= 1236000000000000"), ["entity_id", "t"])


@query(f"select entity_id, count(*) filter (t > {MID}) as n_hot, count(*) filter (t <= {MID}) as n_warm from (select distinct entity_id, t from ingestpoint) group by 1")
def tiers_compact(spark, d):
    p = table(spark, d, "ingestpoint").groupBy("entity_id", "t").agg(F.min("sequence").alias("s"))
    hot, warm = tier_compact(p, p.where("false"), MID)
    n = lambda x, c: x.groupBy("entity_id").agg(F.count(F.lit(1)).alias(c))
    return p.select("entity_id").distinct().join(n(hot, "n_hot"), "entity_id", "left").join(n(warm, "n_warm"), "entity_id", "left").select("entity_id", F.coalesce("n_hot", F.lit(0)).alias("n_hot"), F.coalesce("n_warm", F.lit(0)).alias("n_warm"))


@query("select node_id, sequence % 1000 * 65536 + entity_id % 65536 as packed, sequence % 1000 as episode, entity_id % 65536 as step from ingestpoint")
def episode_packing(spark, d):
    p = table(spark, d, "ingestpoint").withColumn("packed", episodes.encode(F.col("sequence") % 1000, F.col("entity_id") % 65536))
    return p.select("node_id", "packed", episodes.episode(F.col("packed")).alias("episode"), episodes.step(F.col("packed")).alias("step"))


@query(f"{ING} select node_id, i - 1 as dim, cast(trunc(least(greatest((vector[i] + 0.5) * 255.0, 0.0), 255.0)) as integer) as code from pts, range(1, 65) r(i)")
def scalar_codes(spark, d):
    return pts.ingested(spark, d).select("node_id", F.posexplode(vectors.scalar_quantise("vector", -0.5, 0.5)).alias("dim", "code")).withColumn("dim", F.col("dim").cast("long"))


HUBS = "h as (select node_id as hub, vector as hv from pts where node_id % 16 = 0), asg as (select pts.node_id, pts.entity_id, t, hub, list_distance(vector, hv) as dist from pts, h qualify row_number() over (partition by pts.node_id order by round(list_distance(vector, hv)::double ** 2, 9), hub) = 1)"


def _assigned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = pts.ingested(spark, d).select("node_id", "entity_id", "t", "vector")
    h = regions.hubs(p, 1)
    return regions.assign(p, h), h


@query(f"{ING}, {HUBS} select node_id, hub, round(dist * dist * 65536)::bigint as distance_units from asg")
def region_assign(spark, d):
    return _assigned(spark, d)[0].select("node_id", "hub", F.round(F.col("hub_distance") * 65536).cast("long").alias("distance_units"))


@query(f"{ING}, {HUBS} select h.hub, count(asg.node_id) as n_members from h left join asg using (hub) group by 1")
def region_counts(spark, d):
    a, h = _assigned(spark, d)
    return regions.region_counts(a, h)


WEEK = 7 * 86_400_000_000
SHARES = f"w as (select entity_id, hub, (t - min(t) over (partition by entity_id)) // {WEEK} as win, min(t) over (partition by entity_id) as t0 from asg), s as (select entity_id, win, hub, min(t0) + win * {WEEK} + {WEEK // 2} as t, count(*) as n from w group by 1, 2, 3), sh as (select entity_id, win, t, hub, n / sum(n) over (partition by entity_id, win) as share from s)"


@query(f"{ING}, {HUBS}, {SHARES} select entity_id, win, t, hub, round(share, 6) as share from sh")
def region_shares(spark, d):
    return regions.region_shares(_assigned(spark, d)[0], WEEK).withColumn("share", F.round("share", 6))


@query(ING.replace("with ing", "with recursive ing", 1) + f""", {HUBS}, {SHARES},
g as (select x.entity_id, x.win, x.t, y.hub, coalesce(sh.share, 0) as share, row_number() over (partition by x.entity_id, y.hub order by x.win) as i from (select distinct entity_id, win, t from sh) x join (select distinct entity_id, hub from sh) y using (entity_id) left join sh on sh.entity_id = x.entity_id and sh.win = x.win and sh.hub = y.hub),
r as (select entity_id, hub, win, t, share, i from g where i = 1 union all select g.entity_id, g.hub, g.win, g.t, 0.3183099 * g.share + (1 - 0.3183099) * r.share, g.i from r join g on g.entity_id = r.entity_id and g.hub = r.hub and g.i = r.i + 1)
select entity_id, hub, win, t, round(share, 6) as share from r""")
def region_trajectory(spark, d):
    return regions.region_trajectory(_assigned(spark, d)[0], WEEK, 0.3183099).withColumn("share", F.round("share", 6))


DIST = ", ad as (select node_id, entity_id, t, anchor_idx as anchor, 1 - list_inner_product(pts.vector, a.vector) / (sqrt(list_inner_product(pts.vector, pts.vector)) * sqrt(list_inner_product(a.vector, a.vector))) as dd from pts, anchors a)"


def _projected(spark: SparkSession, d: str) -> DataFrame:
    return regions.project_to_anchors(pts.ingested(spark, d), _anchors(spark, d))


@query(f"{ING}{DIST} select node_id, anchor, round(dd, 6) as dist from ad")
def anchor_project(spark, d):
    return _projected(spark, d).select("node_id", F.posexplode("dist").alias("anchor", "dist")).withColumn("dist", F.round("dist", 6))


@query(f"{ING}{DIST}, n as (select *, row_number() over (partition by entity_id, anchor order by t, node_id) as i from ad) select entity_id, anchor, round(avg(dd), 6) as mean, round(min(dd), 6) as min, round(coalesce(case when count(*) > 1 then regr_slope(dd, i) end, 0), 6) as trend, round(arg_max(dd, i), 6) as last from n group by 1, 2")
def anchor_summary(spark, d):
    s = regions.anchor_summary(_projected(spark, d))
    return s.select("entity_id", "anchor", *[F.round(c, 6).alias(c) for c in ("mean", "min", "trend", "last")])


@query(f"""{ING}{DIST}, n as (select entity_id, anchor, arg_min(dd, struct_pack(a := abs(t - {LOW}), b := t, c := node_id)) as d1, arg_min(dd, struct_pack(a := abs(t - {HIGH}), b := t, c := node_id)) as d2 from ad group by 1, 2)
select entity_id, round(sqrt(sum((d2 - d1) ** 2)), 6) as l2, arg_max(anchor, struct_pack(a := abs(d2 - d1), b := anchor)) as dominant from n group by 1""")
def anchor_drift(spark, d):
    return regions.anchor_drift(_projected(spark, d), LOW, HIGH).select("entity_id", F.round("l2", 6).alias("l2"), "dominant")


@query(f"{ING}, u as (select node_id, 0.25 as r from pts where node_id % 5 = 0 union all select node_id, 0.75 from pts where node_id % 10 = 0) select node_id, round(case when node_id % 10 = 0 then 0.75 when node_id % 5 = 0 then 0.25 else reward end, 6) as reward from pts")
def rewards_set(spark, d):
    p = pts.ingested(spark, d)
    new = p.where("node_id % 5 = 0").select("node_id", F.lit(0.25).alias("reward"), F.lit(1).alias("version")).unionByName(p.where("node_id % 10 = 0").select("node_id", F.lit(0.75).alias("reward"), F.lit(2).alias("version")))
    return search.set_rewards(p, new).select("node_id", F.round("reward", 6).alias("reward"))


@query(_sql())
def buffer_union_search(spark, d):
    p = pts.ingested(spark, d)
    return _out(search.nearest_over([p.where(f"t <= {MID}"), p.where(f"t > {MID - WEEK}")], SearchSpec(_q(spark, d))))


@query(_sql(where=f"t between {LOW} and {MID}"))
def partitioned_search(spark, d):
    """The same search over a store written by time bucket; only the buckets of the range are read."""
    from vectide.operators import storage
    from vectide.session import Scratch

    where = Scratch(spark, "store").path()
    storage.write_points(pts.ingested(spark, d).select("node_id", "entity_id", "t", "vector"), where, WEEK)
    return _out(search.nearest(storage.read_range(spark, where, LOW, MID, WEEK), SearchSpec(_q(spark, d))))


@query(f"{ING}{DIST}, qa as (select anchor_idx as anchor, 1 - list_inner_product(q, a.vector) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(a.vector, a.vector))) as x from qv, anchors a), s as (select node_id, entity_id, sum((dd - x) ** 2) as score from ad join qa using (anchor) group by 1, 2) select node_id, entity_id, round(score, 6) as score from s order by s.score, node_id limit 10")
def anchor_space_search(spark, d):
    a = _anchors(spark, d)
    q, p = _q(spark, d), pts.ingested(spark, d)
    even, odd = regions.anchor_points(p.where("node_id % 2 = 0"), a, "even"), regions.anchor_points(p.where("node_id % 2 = 1"), a, "odd")
    import numpy as np

    x = np.array(a)
    want = (1 - x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))).tolist()
    return _out(search.nearest(even.unionByName(odd), SearchSpec(want)))


@query(f"{ING} select entity_id, case when node_id % 2 = 0 then 'even' else 'odd' end as source_model, min(t) as first_t, max(t) as last_t, count(*) as n_points from pts group by 1, 2")
def models_by_entity(spark, d):
    a, p = _anchors(spark, d), pts.ingested(spark, d)
    return regions.by_model(regions.anchor_points(p.where("node_id % 2 = 0"), a, "even").unionByName(regions.anchor_points(p.where("node_id % 2 = 1"), a, "odd")))


@query(f"{ING}, {HUBS} select node_id, entity_id, t from asg where hub = (select min(node_id) from pts where node_id % 16 = 0)")
def region_members(spark, d):
    a, h = _assigned(spark, d)
    return regions.members(a, h.agg(F.min("hub")).first()[0])


@query("""select node_id, case when vector is null or len(vector) = 0 then 'empty_vector' when len(vector) <> 64 then 'wrong_dimension' when t is null then 'timestamp_out_of_range' when len(list_filter(vector, lambda x: x is null or isnan(x))) > 0 then 'nan' when len(list_filter(vector, lambda x: isinf(x))) > 0 then 'infinite' else 'zero_vector' end as reason
from ingestpoint where vector is null or len(vector) <> 64 or t is null or len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) > 0 or len(list_filter(vector, lambda x: x <> 0)) = 0 order by node_id limit 1""")
def first_invalid(spark, d):
    return pts.first_invalid(table(spark, d, "ingestpoint"), "node_id", 64).select("node_id", "reason")


@query()
def diverse_neighbours(spark, d):
    near = search.nearest(pts.ingested(spark, d), SearchSpec(_q(spark, d), 200))
    return search.diverse(near, 10).withColumn("score", F.round("score", 6))
