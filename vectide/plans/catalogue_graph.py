"""Graphs, decision processes, Bayesian networks, labels, deltas and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.operators import graph, learning, storage
from vectide.operators.trajectory import W
from vectide.plans.base import ING, PTS, query
from vectide.session import table
from vectide.sources.points import derived, ingested

EDGES = "e as (select source, target, max(weight) as w from typed_edges where source is not null and target is not null and weight is not null group by 1, 2)"


@query(f"{ING} select entity_id, node_id, lag(node_id) over w as predecessor, lead(node_id) over w as successor from pts window w as (partition by entity_id order by t, node_id)")
def temporal_edges(spark, d):
    return graph.temporal_edges(ingested(spark, d))


@query(f"{PTS}, l as (select node_id, lead(node_id) over w as n1, lead(node_id, 2) over w as n2, lag(node_id) over w as p1, lag(node_id, 2) over w as p2 from pts window w as (partition by entity_id order by t, node_id)) select node_id, s.step::bigint as step, case s.step when 1 then n1 when 2 then n2 when -1 then p1 else p2 end as other from l, (select unnest([1, 2, -1, -2]) as step) s where case s.step when 1 then n1 when 2 then n2 when -1 then p1 else p2 end is not null")
def temporal_walk(spark, d):
    w = graph.walk(derived(spark, d), 2)
    side = lambda c, s: w.select("node_id", F.posexplode(c).alias("i", "other")).select("node_id", ((F.col("i") + 1) * s).cast("long").alias("step"), "other")
    return side("forward", 1).unionByName(side("backward", -1))


@query("select edge_type, count(*) as n_edges, count(distinct source) as n_sources from typed_edges group by 1")
def typed_edge_stats(spark, d):
    return graph.edges_by_type(table(spark, d, "typed_edges"))


@query("select source, target, weight from typed_edges where source = 1 and edge_type = 'reply_to'")
def typed_outgoing(spark, d):
    return graph.outgoing(table(spark, d, "typed_edges"), 1, "reply_to").select("source", "target", "weight")


@query("select edge_type, count(*) as n, round(sum(weight), 6) as w from (select edge_type, case when edge_type = 'reply_to' then weight * 0.5 else weight end as weight from typed_edges where not (coalesce(source, -1) = 1 and edge_type is not null) or source is null) group by 1")
def typed_edges_changed(spark, d):
    e = table(spark, d, "typed_edges")
    gone = e.where("source = 1 and edge_type is not null").select("source", "target", "edge_type").distinct()
    return graph.update_weights(graph.remove_edges(e, gone), "reply_to", 0.5).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("w"))


@query("select source, round(case when coalesce(sum(weight) filter (edge_type in ('causal_success', 'causal_failure')), 0) < 0.01 then 0.5 else (1 + coalesce(sum(weight) filter (edge_type = 'causal_success'), 0)) / (2 + coalesce(sum(weight) filter (edge_type in ('causal_success', 'causal_failure')), 0)) end, 6) as success_score from typed_edges where source is not null group by 1")
def typed_success(spark, d):
    return graph.success_scores(table(spark, d, "typed_edges")).withColumn("success_score", F.round("success_score", 6))


@query(f"""with recursive {EDGES}, r as (select source as start, source as node, 1.0::double as weight, 0 as hop from (select distinct source from e) union
select start, target, weight * w, hop + 1 from r join e on node = source where hop < 3 and weight * w > 0.01 and target <> start)
select start, node, round(max(weight), 6) as weight from r where node <> start group by 1, 2""")
def typed_traverse(spark, d):
    e = table(spark, d, "typed_edges")
    starts = e.where("target is not null and weight is not null and source is not null").select(F.col("source").alias("start")).distinct()
    return graph.traverse(e, starts, None, 3).withColumn("weight", F.round("weight", 6))


@query("""with recursive e as (select distinct source, target from typed_edges where source is not null and target is not null), r as (select source as start, source as node, 0 as hop from (select distinct source from e) union select start, target, hop + 1 from r join e on node = source where hop < 3)
select start, node, min(hop) as hop from r group by 1, 2 having min(hop) > 0""")
def graph_reach(spark, d):
    e = table(spark, d, "typed_edges")
    return graph.reach(e, e.where("source is not null and target is not null").select(F.col("source").alias("start")).distinct(), None, 3)


@query("""with recursive e as (select distinct source, target from typed_edges where source is not null and target is not null), r as (select 1::bigint as node, [1::bigint] as path union all select target, list_append(path, target) from r join e on node = source where len(path) < 5 and not list_contains(path, target)),
b as (select path from r where node = (select max(target) from e where source = (select min(target) from e where source = 1 and target <> 1)) order by len(path), path limit 1)
select unnest(range(1, len(path) + 1)) as place, unnest(path) as node from b""")
def graph_path(spark, d):
    e = table(spark, d, "typed_edges").where("source is not null and target is not null")
    mid = e.where("source = 1 and target <> 1").agg(F.min("target")).first()[0]
    end = e.where(F.col("source") == mid).agg(F.max("target")).first()[0]
    return graph.find_path(e, 1, end if end is not None else 1, 4).select(F.posexplode("path").alias("i", "node")).select((F.col("i") + 1).cast("long").alias("place"), "node")


def _kg(spark, d):
    """Nations and customers' markets as a small knowledge graph."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    ents = n.select(F.col("n_nationkey").cast("long").alias("id"), F.lit("nation").alias("entity_type")).unionByName(r.select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit("region").alias("entity_type")))
    rels = n.select(F.col("n_nationkey").cast("long").alias("source"), (F.col("n_regionkey") + 1000).cast("long").alias("target"), F.lit("in_region").alias("relation_type"), F.lit(1.0).alias("weight")).unionByName(n.select(F.col("n_nationkey").cast("long").alias("source"), (F.col("n_nationkey") + 1).cast("long").alias("target"), F.lit("precedes").alias("relation_type"), F.lit(0.5).alias("weight")))
    return ents, rels


@query("select n_nationkey::bigint as id, 'in_region' as relation_type, n_regionkey::bigint + 1000 as other from nation union all select n_nationkey, 'precedes', n_nationkey + 1 from nation where n_nationkey + 1 in (select n_nationkey from nation)")
def kg_neighbours(spark, d):
    return graph.neighbours(*_kg(spark, d)).drop("weight")


@query("select n_regionkey::bigint + 1000 as id, 'in_region' as relation_type, n_nationkey::bigint as other from nation")
def kg_incoming(spark, d):
    return graph.neighbours(*_kg(spark, d), "in_region", incoming=True).drop("weight")


@query("select (n_nationkey - 3)::int as place, n_nationkey::bigint as step from nation where n_nationkey >= 3")
def task_plan(spark, d):
    n = table(spark, d, "nation").where("n_nationkey >= 3")
    pre = n.select(F.col("n_nationkey").cast("long").alias("source"), (F.col("n_nationkey") + 1).cast("long").alias("target")).where("target <= 24")
    return graph.task_plan(n.select(F.col("n_nationkey").cast("long").alias("step")), pre)


@query("with need as (select distinct o_custkey % 50 as action, o_orderstatus as fact from orders union select distinct o_custkey % 50, o_orderpriority from orders where o_custkey % 7 = 0), st as (select unnest(['F', 'O', 'P', '1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW']) as fact) select a.action, count(n.fact) as n_missing from (select distinct o_custkey % 50 as action from orders) a left join (select * from need where fact not in (select fact from st)) n using (action) group by 1")
def missing_preconditions(spark, d):
    o = table(spark, d, "orders").withColumn("action", F.col("o_custkey") % 50)
    needs = o.select("action", F.col("o_orderstatus").alias("fact")).unionByName(o.where("o_custkey % 7 = 0").select("action", F.col("o_orderpriority").alias("fact"))).distinct()
    state = spark.createDataFrame([(x,) for x in ("F", "O", "P", "1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")], "fact string")
    return graph.missing_preconditions(o, needs, state)


def _episodes(spark, d):
    """Days of users as episodes: step, region (label), action (event type), reward."""
    p = derived(spark, d)
    return p.withColumn("episode_id", F.col("entity_id")).withColumn("step", F.row_number().over(W())).select("episode_id", "step", F.col("label").alias("region"), F.col("event_type").alias("action"), F.least(F.col("value") / 100, F.lit(1.0)).alias("reward"))


EP = f"{PTS}, ep as (select entity_id as episode_id, row_number() over (partition by entity_id order by t, node_id) as step, label as region, event_type as action, least(value / 100, 1.0) as reward from pts)"


@query(f"{EP}, m as (select *, lead(region) over (partition by episode_id order by step) as nr from ep), c as (select region, action, nr as next_region, count(*) as n from m where nr is not null group by 1, 2, 3) select *, round(n / sum(n) over (partition by region, action), 6) as probability from c")
def mdp_transitions(spark, d):
    return learning.transitions(_episodes(spark, d)).withColumn("probability", F.round("probability", 6))


@query(f"{EP} select region, round(avg(reward), 6) as quality, round(0.7 + 0.25 * avg(reward), 6) as decay from ep group by 1")
def mdp_quality(spark, d):
    q = learning.region_quality(_episodes(spark, d))
    return q.select("region", F.round("quality", 6).alias("quality"), F.round("decay", 6).alias("decay"))


@query(f"{EP}, m as (select *, lead(step) over (partition by episode_id order by step) as later from ep), s as (select region, action, count(*) as n, (1 + count(*) filter (reward > 0.5)) / (2 + count(*)) as success from m where later is not null group by 1, 2) select region, action, n, round(success, 6) as success, row_number() over (partition by region order by success desc, action)::int as rank from s")
def mdp_action_success(spark, d):
    return learning.action_success(_episodes(spark, d)).withColumn("success", F.round("success", 6))


STATES = {"event_type": ["click", "error", "purchase", "signup", "view"], "size": ["low", "high"], "half": ["am", "pm"]}
NET = f"{PTS}, r as (select event_type, case when value < 50 then 'low' else 'high' end as size, case when t % 86400000000 < 43200000000 then 'am' else 'pm' end as half from pts)"


def _network(spark, d):
    rows = derived(spark, d).select("event_type", F.when(F.col("value") < 50, "low").otherwise("high").alias("size"), F.when(F.col("t") % 86_400_000_000 < 43_200_000_000, "am").otherwise("pm").alias("half"))
    net = learning.Network(STATES, {"size": ["event_type", "half"], "event_type": ["half"]})
    net.learn(rows)
    return net


@query(f"{NET} select event_type, half, size, count(r2.size) as n, round((count(r2.size) + 1) / (sum(count(r2.size)) over (partition by event_type, half) + 2), 6) as probability from (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as event_type) cross join (select unnest(['am', 'pm']) as half) cross join (select unnest(['low', 'high']) as size) left join r r2 using (event_type, half, size) group by 1, 2, 3")
def bn_learn(spark, d):
    return _network(spark, d).cpt["size"].withColumn("probability", F.round("probability", 6))


@query(f"""{NET}, h as (select half, (count(*) + 1) / (sum(count(*)) over () + 2) as p from r group by 1), e as (select half, event_type, (count(*) + 1) / (sum(count(*)) over (partition by half) + 5) as p from r group by 1, 2), s as (select event_type, half, size, (count(*) + 1) / (sum(count(*)) over (partition by event_type, half) + 2) as p from r group by 1, 2, 3),
m as (select event_type as state, sum(h.p * e.p * s.p) as m from h join e using (half) join s using (half, event_type) where size = 'high' group by 1) select state, round(m / sum(m) over (), 6) as probability from m""")
def bn_posterior(spark, d):
    return _network(spark, d).posterior("event_type", {"size": "high"}).withColumn("probability", F.round("probability", 6))


@query("""with w as (select lower(trim(label)) as label, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from unified where label is not null and text is not null),
tf as (select label, term, count(*) as n from w group by 1, 2), z as (select label, sum(n) as size from tf group by 1), a as (select term, sum(n) as al from tf group by 1),
s as (select label, term, n / size * ln(1 + (select avg(size) from z) / al) as weight from tf join z using (label) join a using (term))
select label, term, round(weight, 6) as weight, row_number() over (partition by label order by weight desc, term)::int as rank from s qualify row_number() over (partition by label order by weight desc, term) <= 5""")
def class_terms(spark, d):
    u = table(spark, d, "unified").withColumn("label", F.lower(F.trim("label")))
    return learning.class_terms(u, "label", "text").withColumn("weight", F.round("weight", 6))


@query("""with s as (select case when event_type = 'purchase' then 1 else 0 end as y, value / 200 as s from events), c as (select y, s, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from s), k as (select sum(y) as np, count(*) - sum(y) as nq, sum(case when y = 1 then r end) as rs, count(*) filter (s >= 0.5 and y = 1) as tp, count(*) filter (s >= 0.5 and y = 0) as fp from c)
select (np + nq)::bigint as n, round((rs - np * (np + 1) / 2.0) / (np * nq), 6) as auc, round(tp / (tp + fp), 6) as "precision", round(tp / np, 6) as recall, round(2.0 * tp / (tp + fp + np), 6) as f1 from k""")
def binary_metrics(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y"), (F.col("value") / 200).alias("s"))
    m = learning.binary_metrics(e, "y", "s")
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query("select split, label, cast(case when split = 'train' then ceil(0.8 * n) else n - ceil(0.8 * n) end as bigint) as n_users from (select case when event_type in ('view', 'click') then 'a' else 'b' end as label, count(distinct user_id) as n from events group by 1), (select unnest(['train', 'test']) as split)")
def stratified_split(spark, d):
    u = table(spark, d, "events").select("user_id", F.when(F.col("event_type").isin("view", "click"), "a").otherwise("b").alias("label"))
    return learning.stratified_split(u, "user_id", "label").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_users"))


@query(f"""{PTS}, l as (select *, row_number() over w - 1 as seq, lag(vector) over w as v0 from pts window w as (partition by entity_id order by t, node_id))
select node_id, seq % 10 = 0 as keyframe, case when seq % 10 = 0 then 64 else len(list_filter(list_zip(vector, v0), lambda z: abs(z[1] - z[2]) > 0.1)) end::int as n_values from l""")
def delta_encode(spark, d):
    return storage.delta_encode(derived(spark, d), 10, 0.1).select("node_id", "keyframe", F.size("indices").alias("n_values"))


@query(f"{PTS} select node_id, round(vector[1], 6) as v0, round(vector[64], 6) as v63 from pts")
def delta_roundtrip(spark, d):
    out = storage.delta_decode(storage.delta_encode(derived(spark, d), 10), 10, 64)
    return out.select("node_id", F.round(F.col("vector")[0], 6).alias("v0"), F.round(F.col("vector")[63], 6).alias("v63"))


@query(f"""{PTS}, l as (select *, row_number() over w - 1 as seq, lag(vector) over w as v0 from pts window w as (partition by entity_id order by t, node_id))
select round(count(*) * 256 / sum(case when seq % 10 = 0 then 256 else 8 * len(list_filter(list_zip(vector, v0), lambda z: abs(z[1] - z[2]) > 0.1)) end), 6) as ratio from l""")
def delta_compression(spark, d):
    return storage.compression(storage.delta_encode(derived(spark, d), 10, 0.1), 64).withColumn("ratio", F.round("ratio", 6))


@query()
def pq_search(spark, d):
    p = ingested(spark, d)
    book = storage.Codebook.train(p, 16, 64, 5)
    q = [float(x) for x in table(spark, d, "anchors").where("anchor_idx = 0").first()["vector"]]
    return book.search(p, q, 10).select("node_id", F.round("score", 6).alias("score"))


@query("with n as (select entity_id, t, max(sequence) + 5 as s from ingestpoint where entity_id < 50 group by 1, 2), o as (select entity_id, t, min(sequence) as s from ingestpoint group by 1, 2) select entity_id, t, coalesce(n.s, o.s) as s from o left join n using (entity_id, t) where entity_id <> 3")
def store_put_delete(spark, d):
    p = table(spark, d, "ingestpoint")
    old = p.groupBy("entity_id", "t").agg(F.min("sequence").alias("s"))
    new = p.where("entity_id < 50").groupBy("entity_id", "t").agg((F.max("sequence") + 5).alias("s"))
    return storage.delete(storage.put(old, new, ["entity_id", "t"]), old.where("entity_id = 3"), ["entity_id"])


@query("select 'nation' as kind, count(*) as n from nation union all select 'region', count(*) from region union all select 'in_region', count(*) from nation union all select 'precedes', count(*) from nation")
def kg_stats(spark, d):
    return graph.graph_stats(*_kg(spark, d))


@query("select r_regionkey::bigint + 1000 as id from region")
def kg_entities_of_type(spark, d):
    return graph.entities_by_type(_kg(spark, d)[0], "region").select("id")
