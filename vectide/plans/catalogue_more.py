"""Planted truths, decision processes, task rules, anchors, metrics and logs on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import vectors
from vectide.operators import features, graph, learning, mining, regions, search
from vectide.plans import catalogue_mining  # noqa: F401 - its SQL is used below
from vectide.plans.base import ING, PTS, SQL, query
from vectide.plans.catalogue_graph import EP, NET, _episodes, _network
from vectide.plans.catalogue_search import DIST, _anchors, _out, _q
from vectide.session import micros, table
from vectide.sources.points import derived, ingested


def _planted(spark: SparkSession, n: int, entities: int, value: str) -> DataFrame:
    """Points of trajectories made by arithmetic from entity e, place i and dimension k, four dimensions each."""
    grid = spark.range(n * entities).selectExpr("id as node_id", f"id div {n} as e", f"cast(id % {n} as int) as i")
    vector = F.expr(f"transform(sequence(0, 3), k -> cast({value} as double))")
    return grid.select("node_id", F.col("e").alias("entity_id"), (F.col("i") * 1000).cast("long").alias("t"), vector.alias("vector"))


NOISE = "((e * 31 + i * 7919 + k * 104729) % 1000) / 10000.0"


@query("select e as entity_id, i * 1000 as t from range(0, 20) a(e), (select unnest([50, 100, 150]) as i)")
def change_points_planted(spark, d):
    """Three steps in each of twenty trajectories of 200 points."""
    p = _planted(spark, 200, 20, f"element_at(array(0, 8, -3, 5), cast(i div 50 as int) + 1) + {NOISE}")
    return mining.change_points(p).select("entity_id", "t")


@query("select e as entity_id, i * 1000 as t from range(0, 20) a(e), (select unnest([100]) as i)")
def online_changes_planted(spark, d):
    """One step at place 100 of 120; the detector sees it at once."""
    return mining.online_changes(_planted(spark, 120, 20, f"case when i < 100 then 0 else 50 end + {NOISE}")).select("entity_id", "t").where("t <= 100000")


@query("select e as entity_id, 0 as rank, i::int as start, 30 as period from range(0, 20) a(e), (select unnest([10, 40, 70]) as i)")
def motifs_planted(spark, d):
    """One figure of five points at places 10, 40 and 70 of a slow ramp."""
    p = _planted(spark, 100, 20, "case when i between 10 and 14 then 10 + 0.5 * (i - 10) + 0.1 * k when i between 40 and 44 then 10 + 0.5 * (i - 40) + 0.1 * k when i between 70 and 74 then 10 + 0.5 * (i - 70) + 0.1 * k else 0.01 * i + k end")
    return mining.motifs(p, 5, 1).select("entity_id", "rank", "start", "period")


@query("select (2 * e)::bigint as a, (2 * e + 1)::bigint as b, case when e % 2 = 0 then 'a_to_b' else 'b_to_a' end as direction, 1 as lag from range(0, 10) t(e)")
def granger_planted(spark, d):
    """Of each pair the one follows the other by a step."""
    lead = "(pmod(xxhash64(i + {s}, k, e div 2), 1001) - 500) / 100.0"
    a, b = lead.format(s=1), lead.format(s=0)
    p = _planted(spark, 200, 20, f"case when e % 2 = (e div 2) % 2 then {a} else {b} + (pmod(xxhash64(e, i, k), 97) - 48) / 20.0 end")
    pairs = spark.range(10).selectExpr("id * 2 as a", "id * 2 + 1 as b")
    return mining.granger(p, pairs, 1, 1e-6).select("a", "b", "direction", "lag")


@query(SQL["topology"].replace(SQL["topology"][SQL["topology"].rindex("f as (select"):], "f as (select entity_id, unnest(death) as death from r join g using (entity_id) where step = n) select entity_id, round(death, 6) as death from f"))
def persistence(spark, d):
    """When each trajectory's components die, but for the one that never does."""
    return mining.persistence(derived(spark, d)).where("death < double('infinity')").select("entity_id", F.round("death", 6).alias("death"))


@query(f"{SQL['persistence'][:SQL['persistence'].rindex(') select entity_id, round(death')]}), q as (select unnest([0.0, 0.5, 1.0, 1.2, 2.0]) as radius) select g.entity_id, radius::double as radius, (1 + count(death) filter (death > radius))::int as betti from g cross join q left join f using (entity_id) group by 1, 2")
def betti_curve(spark, d):
    return mining.betti_curve(derived(spark, d), [0.0, 0.5, 1.0, 1.2, 2.0])


MOVED = f"{EP}, m as (select *, lead(step) over (partition by episode_id order by step) as later from ep)"


@query(f"{MOVED}, s as (select region, action, (1 + count(*) filter (reward > 0.5)) / (2 + count(*)) as success, row_number() over (partition by region order by (1 + count(*) filter (reward > 0.5)) / (2 + count(*)) desc, action) as place from m where later is not null group by 1, 2) select region, 'Action success rates: ' || string_agg(action || '(' || printf('%.0f', success * 100) || '%)', ', ' order by place) as hint from s where place <= 3 group by 1")
def mdp_hints(spark, d):
    return learning.hints(_episodes(spark, d))


@query(f"{MOVED} select count(*) filter (later is not null and action is not null) as n_transitions, (select count(*) from (select distinct region, action from m where later is not null and action is not null)) as n_state_actions, count(distinct region) as n_regions from m")
def mdp_stats(spark, d):
    return learning.mdp_stats(_episodes(spark, d))


@query(f"{EP}, v as (select region, episode_id, arg_min(reward, step) as reward from ep group by 1, 2) select region, round(coalesce(avg(reward), 0.5), 6) as quality from v group by 1")
def mdp_quality_distinct(spark, d):
    return learning.region_quality(_episodes(spark, d), distinct=True).select("region", F.round("quality", 6).alias("quality"))


@query(f"{MOVED}, s as (select region, action, (1 + count(*) filter (reward > 0.5)) / (2 + count(*)) as success from m where later is not null group by 1, 2), q as (select region, avg(reward) as quality from ep group by 1), a as (select region, unnest(['view', 'never']) as action from (select distinct region from ep union all select 99)) select a.region, a.action, round(coalesce(success, quality, 0.5), 6) as success from a left join s using (region, action) left join q using (region)")
def mdp_default(spark, d):
    e = _episodes(spark, d)
    asked = e.select("region").distinct().unionByName(spark.range(1).select(F.lit(99).alias("region"))).select("region", F.explode(F.array(F.lit("view"), F.lit("never"))).alias("action"))
    return learning.success_or_default(e, asked).withColumn("success", F.round("success", 6))


NEEDS = "need as (select distinct o_custkey % 50 as action, o_orderpriority as fact from orders where o_custkey % 97 = 0), st as (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW', '4-NOT SPECIFIED']) as fact)"


def _needs(spark: SparkSession, d: str, facts: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, d, "orders").withColumn("action", F.col("o_custkey") % 50)
    return o, o.where("o_custkey % 97 = 0").select("action", F.col("o_orderpriority").alias("fact")).distinct(), spark.createDataFrame([(x,) for x in facts], "fact string")


@query(f"with {NEEDS.replace(chr(44) + ' ' + chr(39) + '4-NOT SPECIFIED' + chr(39), '')} select distinct o_custkey % 50 as action from orders where o_custkey % 50 not in (select action from need where fact not in (select fact from st))")
def valid_actions(spark, d):
    return graph.valid_actions(*_needs(spark, d, ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")))


@query("select fact from (select unnest(['F', 'P']) as fact) union select distinct o_orderstatus from orders")
def apply_action(spark, d):
    state = spark.createDataFrame([("F",), ("P",)], "fact string")
    return graph.apply_action(state, table(spark, d, "orders").select(F.col("o_orderstatus").alias("fact")))


@query(f"""{NET}, h as (select half, (count(*) + 1) / (sum(count(*)) over () + 2) as p from r group by 1), e as (select half, event_type, (count(*) + 1) / (sum(count(*)) over (partition by half) + 5) as p from r group by 1, 2), s as (select event_type, half, size, (count(*) + 1) / (sum(count(*)) over (partition by event_type, half) + 2) as p from r group by 1, 2, 3)
select event_type as state from h join e using (half) join s using (half, event_type) where size = 'low' group by 1 order by sum(h.p * e.p * s.p) desc limit 1""")
def bn_most_likely(spark, d):
    return _network(spark, d).most_likely("event_type", {"size": "low"})


@query(f"{ING}{DIST} select entity_id, case when node_id % 2 = 0 then 'even' else 'odd' end as source_model, (dense_rank() over (partition by entity_id, node_id % 2 order by t, node_id))::int as place, node_id, round(dd, 6) as x0 from ad where anchor = 0")
def model_trajectories(spark, d):
    a, p = _anchors(spark, d), ingested(spark, d)
    both = regions.anchor_points(p.where("node_id % 2 = 0"), a, "even").unionByName(regions.anchor_points(p.where("node_id % 2 = 1"), a, "odd"))
    return regions.trajectories_by_model(both).select("entity_id", "source_model", "place", "node_id", F.round(F.col("vector")[0], 6).alias("x0"))


@query(f"""{ING}, m as (select list(m order by i) as c from (select i, avg(vector[i]) as m from pts, range(1, 65) r(i) group by i)), av as (select anchor_idx as anchor, list_transform(list_zip(vector, c), lambda z: z[1] - z[2]) as a from anchors, m), pv as (select node_id, entity_id, t, list_transform(list_zip(vector, c), lambda z: z[1] - z[2]) as v from pts, m),
n as (select entity_id, anchor, 1 - list_inner_product(v, a) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(a, a))) as dd, row_number() over (partition by entity_id, anchor order by t, node_id) as i from pv, av)
select entity_id, anchor, round(avg(dd), 6) as mean, round(min(dd), 6) as min, round(coalesce(case when count(*) > 1 then regr_slope(dd, i) end, 0), 6) as trend, round(arg_max(dd, i), 6) as last from n group by 1, 2""")
def centred_summary(spark, d):
    p = ingested(spark, d)
    c = search.centroid_vector(p).first()  # one row
    s = regions.centred_summary(p, _anchors(spark, d), list(c["centroid"]) if c and c["centroid"] else [0.0] * 64)
    return s.select("entity_id", "anchor", *[F.round(x, 6).alias(x) for x in ("mean", "min", "trend", "last")])


CODE = "list_transform({}, lambda x: trunc(least(greatest((x + 0.5) * 255.0, 0.0), 255.0)))"


@query(f"{ING}, c as (select node_id, entity_id, sqrt(list_sum(list_transform(list_zip({CODE.format('vector')}, {CODE.format('q')}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / 255.0 as s from pts, qv) select node_id, entity_id, round(s, 6) as score from c order by s, node_id limit 10")
def quantised_search(spark, d):
    """The nearest by codes of one byte a component alone."""
    p, q = ingested(spark, d), _q(spark, d)
    codes = vectors.scalar_quantise(F.array(*[F.lit(x) for x in q]), -0.5, 0.5)
    return _out(p.withColumn("score", vectors.quantised_distance(vectors.scalar_quantise("vector", -0.5, 0.5), codes, -0.5, 0.5)).orderBy("score", "node_id").limit(10))


WEIGHT = "(case when u < 0.36788 then 0 when u < 0.73576 then 1 when u < 0.91970 then 2 when u < 0.98101 then 3 when u < 0.99634 then 4 else 5 end)"
TURNS = "t as (select y, s, x, r, (((k % 2147483647) * 48271 + r * 69621) % 2147483647) as a from b, range(1, {} + 1) q(r)), w as (select y, s, x, r, {} as w from (select *, ((a * a) % 2147483647) / 2147483647.0::double as u from t))"


@query(f"with b as (select null as y, null as s, value as x, event_id as k from events where value is not null), {TURNS.format(100, WEIGHT)}, m as (select r, sum(x * w) / sum(w) as m from w group by 1) select round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m")
def bootstrap_interval(spark, d):
    b = learning.bootstrap_mean(table(spark, d, "events"), "value", 100, key="event_id")
    return b.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""with b as (select case when event_type = 'purchase' then 1 else 0 end as y, value / 200 as s, null as x, event_id as k from events), {TURNS.format(20, WEIGHT)},
p as (select r, s, sum(case when y = 1 then w else 0 end) as p, sum(case when y = 0 then w else 0 end) as q from w where w > 0 group by 1, 2), o as (select *, coalesce(sum(q) over (partition by r order by s rows between unbounded preceding and 1 preceding), 0) as less from p),
z as (select r, sum(p) as np, sum(q) as nq, sum(p * (less + q / 2.0)) as u, sum(case when s >= 0.5 then p else 0 end) as tp, sum(case when s >= 0.5 then q else 0 end) as fp from o group by 1),
f as (select u / (np * nq) as auc, coalesce(tp / nullif(tp + fp, 0), 0) as prec, tp / np as rec from z where np * nq > 0), l as (select 'auc' as metric, auc as v from f union all select 'precision', prec from f union all select 'recall', rec from f union all select 'f1', coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) from f)
select metric, round(avg(v), 6) as mean, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high from l group by 1""")
def bootstrap_metrics(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y"), (F.col("value") / 200).alias("s"), "event_id")
    m = learning.bootstrap_metrics(e, "y", "s", "event_id", 20)
    return m.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query()
def anchor_features(spark, d):
    """The feature table of a classifier: nine anchors against the tenth."""
    a = _anchors(spark, d)
    f = features.anchor_features(ingested(spark, d), {f"a{i}": v for i, v in enumerate(a[:-1])}, a[-1])
    return f.select("entity_id", "n_posts", *[F.round(c, 6).alias(c) for c in ("a0_mean", "a0_min", "a0_trend", "healthy_mean", "symptom_healthy_ratio", "hurst_anchor_space", "global_dispersion", "dispersion_ratio", "mean_pairwise_sim", "tortuosity", "vel_spikes")])


LOGS = """with ev as (select user_id::varchar as user, epoch_us(ts) // 86400000000 as day, hour(ts) as h, event_type, value, event_id from events),
a as (select user, day, h, event_type, (event_id % 7)::varchar as pc, null::varchar as recipient, 'web' as log from ev where event_type in ('view', 'click') union all select user, day, h, event_type, null, ((event_id * 7) % 150)::varchar || case when event_id % 3 = 0 then '@home.test' else '@else.test' end, 'mail' from ev where event_type in ('purchase', 'signup')),
s as (select user, day, sum(case when event_type = 'view' then 1 else 0 end) as n_views, sum(case when event_type = 'click' then 1 else 0 end) as n_clicks, sum(case when log = 'mail' then 1 else 0 end) as n_sent, round(avg(case when h < 7 or h >= 19 then 1.0 else 0.0 end), 6) as after_hours_ratio, count(distinct pc) as unique_pcs, round(coalesce(avg(case when recipient is not null then case when recipient like '%@home.test' then 0.0 else 1.0 end end), 0), 6) as external_ratio from a group by 1, 2),
g as (select split_part(recipient, '@', 1) as user, day, count(*) as n_received from a where recipient like '%@home.test' group by 1, 2)
select user, day, n_views, n_clicks, n_sent, coalesce(n_received, 0) as n_received, after_hours_ratio, unique_pcs, case when (day + 3) % 7 >= 5 then 1 else 0 end as weekend_flag, external_ratio from s left join g using (user, day)"""


@query(LOGS)
def daily_features(spark, d):
    """Two logs made of the events: pages on machines, and mail to users of two domains."""
    e = table(spark, d, "events")
    base = e.select(F.col("user_id").alias("user"), micros(e, "ts").alias("t_us"), F.col("event_type").alias("activity"), "event_id")
    web = base.where("activity in ('view', 'click')").withColumn("pc", F.col("event_id") % 7)
    to = F.concat(((F.col("event_id") * 7) % 150).cast("string"), F.when(F.col("event_id") % 3 == 0, "@home.test").otherwise("@else.test"))
    mail = base.where("activity in ('purchase', 'signup')").withColumn("recipient", to)
    out = features.daily_features({"web": (web, {"n_views": "view", "n_clicks": "click"}), "mail": (mail, {"n_sent": ""})}, "mail", internal="home.test")
    return out.withColumn("after_hours_ratio", F.round("after_hours_ratio", 6)).withColumn("external_ratio", F.round("external_ratio", 6))
