"""Whole-trajectory kernels; checked against plain versions in the tests where SQL can't express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.functions import vectors
from vectide.operators import cohort, mining, regions
from vectide.plans.base import PTS, SQL, query
from vectide.plans import catalogue_series  # noqa: F401
from vectide.session import table
from vectide.sources.points import derived, ingested

DAY = 86_400_000_000
PAIR_JOIN = SQL['temporal_join'].replace('select distinct entity_id from pts) where entity_id % 2 = 1', 'select distinct entity_id from pts) where entity_id = 1').replace('select a, b, min(lo)', 'select min(lo)').replace(', max(na) as points_a, max(nb) as points_b', ', count(*) over () as n_windows')


def _pairs(p):
    return p.select(F.col("entity_id").alias("a")).distinct().where("a % 2 = 1").withColumn("b", F.col("a") + 1)


@query()
def change_points(spark, d):
    return mining.change_points(derived(spark, d), 1.0).select("entity_id", "t", F.round("severity", 6).alias("severity"), "method")


ONLINE = f"""{PTS.replace('with ', 'with recursive ', 1)}, l as (select entity_id, row_number() over (partition by entity_id order by t, node_id) as i, t, list_transform(vector, lambda x: x::double * 20) as v from pts),
s as (select entity_id, i, t, v as mean, list_transform(v, lambda x: 1.0::double) as var, v as anchor, 1 as since, null::double as severity from l where i = 1
union all select entity_id, i, t, m2, var2, case when hit then m2 else anchor end, case when hit then 0 else since end, case when hit then 1 - exp(-list_distance(m2, anchor)) end from (
select *, cnt > 5 and since >= 5 and score > 1.5 as hit from (
select l.entity_id, l.i, l.t, s.anchor, s.since + 1 as since, l.i as cnt, sqrt(list_sum(list_transform(list_zip(l.v, s.mean, s.var), lambda z: (z[1] - z[2]) ** 2 / greatest(z[3], 1e-10))) / len(l.v)) as score,
list_transform(list_zip(l.v, s.mean), lambda z: z[2] + 0.05 * (z[1] - z[2])) as m2, list_transform(list_zip(l.v, s.mean, s.var), lambda z: 0.95 * (z[3] + 0.05 * (z[1] - z[2]) ** 2)) as var2 from s join l on l.entity_id = s.entity_id and l.i = s.i + 1)))"""


@query(f"{ONLINE} select entity_id, t, round(severity, 6) as severity, 'online' as method from s where severity is not null")
def online_changes(spark, d):
    return mining.online_changes(derived(spark, d).withColumn("vector", vectors.scale("vector", 20.0)), threshold=1.5).select("entity_id", "t", F.round("severity", 6).alias("severity"), "method")


@query(f"""{PTS}, l as (select entity_id, row_number() over w - 1 as i, list_distance(lead(vector) over w, vector) as x from pts window w as (partition by entity_id order by t, node_id)), s as (select entity_id, i, x from l where x is not null),
n as (select entity_id, count(*) as n from s group by 1), b as (select s.entity_id, w, i // w as blk, i, x from s join n using (entity_id) join (select unnest([4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]) as w) q on w <= n // 2 where i // w < n // w),
m as (select *, x - avg(x) over (partition by entity_id, w, blk) as dx from b), c as (select *, sum(dx) over (partition by entity_id, w, blk order by i) as cs from m),
r as (select entity_id, w, blk, case when stddev_pop(x) > 1e-15 then (max(cs) - min(cs)) / stddev_pop(x) else 0 end as rs from c group by 1, 2, 3), f as (select entity_id, w, avg(rs) as rs from r group by 1, 2 having avg(rs) > 0)
select p.entity_id, round(coalesce(h, 0.5), 6) as hurst from (select entity_id from pts group by 1 having count(*) >= 10) p left join (select entity_id, least(greatest(regr_slope(ln(rs), ln(w)), 0), 1) as h from f group by 1 having count(*) >= 2) using (entity_id)""")
def hurst(spark, d):
    return mining.hurst(derived(spark, d)).withColumn("hurst", F.round("hurst", 6))


WINS = f"{PTS}, l as (select entity_id, row_number() over (partition by entity_id order by t, node_id) - 1 as i, vector as v from pts), dd as (select a.entity_id, a.i, b.i - a.i as lag, list_distance(a.v, b.v)::double ** 2 as d from l a join l b on a.entity_id = b.entity_id and b.i >= a.i + 2), u as (select entity_id, i, lag, sum(d) over w as d, count(*) over w as n from dd window w as (partition by entity_id, lag order by i rows between current row and 3 following)), w as (select entity_id, i, i + lag as j, sqrt(d / 4) as dd from u where n = 4 union all select entity_id, i + lag, i, sqrt(d / 4) from u where n = 4), p as (select entity_id, i, min(dd) as dd from w group by 1, 2)"


@query(f"{WINS} select entity_id, i::int as start, round(dd, 6) as distance from p")
def matrix_profile(spark, d):
    return mining.matrix_profile(derived(spark, d), 4).select("entity_id", "start", F.round("distance", 6).alias("distance"))


@query()
def motifs(spark, d):
    m = mining.motifs(derived(spark, d), 4, 3)
    return m.select("entity_id", "rank", "canonical", "start", "t", F.round("distance", 6).alias("distance"), "period")


@query(f"{WINS}, a as (select entity_id, i, dd from p qualify row_number() over (partition by entity_id order by dd desc, i) = 1), b as (select p.entity_id, p.i, p.dd from p join a using (entity_id) where not (p.i >= a.i - 2 and p.i < a.i + 2) qualify row_number() over (partition by p.entity_id order by p.dd desc, p.i) = 1), c as (select p.entity_id, p.i, p.dd from p join a using (entity_id) join b using (entity_id) where not (p.i >= a.i - 2 and p.i < a.i + 2) and not (p.i >= b.i - 2 and p.i < b.i + 2) qualify row_number() over (partition by p.entity_id order by p.dd desc, p.i) = 1) select entity_id, 0 as rank, i::int as start, round(dd, 6) as distance from a union all select entity_id, 1, i, round(dd, 6) from b union all select entity_id, 2, i, round(dd, 6) from c")
def discords(spark, d):
    return mining.discords(derived(spark, d), 4, 3).select("entity_id", "rank", "start", F.round("distance", 6).alias("distance"))


STEPS = f"{PTS}, s as (select entity_id, vector as v, lead(vector) over w as v1, first_value(vector) over w as v0 from pts window w as (partition by entity_id order by t, node_id)), r as (select entity_id, i.i as a, v[i.i] - v0[i.i] as x, list_transform(list_zip(v1, v), lambda z: z[1] - z[2]) as dx from s, range(1, 65) i(i) where v1 is not null)"


@query(f"{STEPS}, one as (select entity_id, b - 1 as pos, sum(dx[b]) as x from r, range(1, 65) b(b) where a = 1 group by 1, 2), two as (select entity_id, 64 + (a - 1) * 64 + b - 1 as pos, sum(x * dx[b]) as x from r, range(1, 65) b(b) group by 1, 2) select entity_id, pos::int as pos, round(x, 6) + 0 as value from (select * from one union all select * from two)")
def signature(spark, d):
    return mining.signatures(derived(spark, d)).select("entity_id", F.posexplode("signature").alias("pos", "value")).withColumn("value", F.round("value", 6) + 0.0)


@query(f"{STEPS}, two as (select entity_id, a, b, sum(x * dx[b]) as x from r, range(1, 65) b(b) group by 1, 2, 3), u as (select p.entity_id, p.a, p.b, (p.x - q.x) / 2 as x from two p join two q on p.entity_id = q.entity_id and p.a = q.b and p.b = q.a and p.a < p.b) select entity_id, (row_number() over (partition by entity_id order by a, b) + 63)::int as place, round(x, 6) + 0 as value from u")
def log_signature(spark, d):
    s = mining.signatures(derived(spark, d), log=True).select("entity_id", F.posexplode("signature").alias("place", "value"))
    return s.where("place >= 64").select("entity_id", "place", (F.round("value", 6) + 0.0).alias("value"))


@query()
def trajectory_search(spark, d):
    p = derived(spark, d)
    recent = [list(r["vector"]) for r in p.where("entity_id = 1").orderBy("t", "node_id").limit(20).collect()]
    return mining.trajectory_search(p, recent, 5).withColumn("distance", F.round("distance", 6))


@query(f"""{PTS.replace('with ', 'with recursive ', 1)}, g as materialized (select entity_id, list(vector order by t, node_id) as vs, count(*)::int as n from pts group by 1),
r as (select entity_id, 1 as step, list_transform(range(1, n + 1), lambda i: case when i = 1 then null else list_distance(vs[1], vs[i])::double end) as near, []::double[] as death from g
union all select entity_id, step + 1, list_transform(range(1, n + 1), lambda i: case when near[i] is null or i = place then null else least(near[i], list_distance(vs[place], vs[i])::double) end), list_append(death, low) from (select r.*, g.vs, g.n, list_min(near) as low, list_position(near, list_min(near)) as place from r join g using (entity_id) where step < n)),
f as (select entity_id, death, list_sum(death) as total from r join g using (entity_id) where step = n)
select entity_id, (len(list_filter(death, lambda x: x > 0)) + 1)::int as n_components, round(coalesce(total, 0), 6) as total_persistence, round(coalesce(list_max(death), 0), 6) as max_persistence, round(coalesce(list_avg(death), 0), 6) as mean_persistence, round(coalesce(list_sum(list_transform(list_filter(death, lambda x: x > 0), lambda x: -x / total * ln(x / total))), 0), 6) as entropy from f""")
def topology(spark, d):
    t = mining.topology(derived(spark, d), 5)
    return t.select("entity_id", "n_components", *[F.round(c, 6).alias(c) for c in ("total_persistence", "max_persistence", "mean_persistence", "entropy")])


@query()
def principal_plane(spark, d):
    return mining.plane(derived(spark, d)).select("entity_id", "t", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""{PTS}, s as (select entity_id, t, vector as v, lead(t) over w as t1, lead(vector) over w as v1, first_value(vector) over w as f, first_value(t) over w as t0 from pts window w as (partition by entity_id order by t, node_id)),
z as (select entity_id, any_value(f) as f, any_value(t0) as t0, arg_max(v, t) filter (v1 is null) as l, max(t) as tl, count(*) as n, stddev_samp((v1[1] - v[1]) / greatest(t1 - t, 1)) as vol0, stddev_samp((v1[64] - v[64]) / greatest(t1 - t, 1)) as vol63 from s group by 1 having count(*) >= 2),
st as (select entity_id, row_number() over (partition by entity_id order by t) as i, list_distance(v1, v)::double as x from s where v1 is not null),
b as (select entity_id, (t - t0) // {DAY} as bk, arg_max(v, struct_pack(a := t)) as v from s group by 1, 2), bd as (select entity_id, avg(x) as day_drift from (select entity_id, list_distance(v, lag(v) over (partition by entity_id order by bk)) as x from b) group by 1)
select entity_id, 132::int as n_features, round((l[1] - f[1]) / greatest(tl - t0, 1) * 1e12, 4) as velocity_0, round((l[64] - f[64]) / greatest(tl - t0, 1) * 1e12, 4) as velocity_63, round(list_distance(l, f), 6) as drift, round(case when n > 2 then vol0 else 0 end * 1e9, 4) as volatility_0, round(case when n > 2 then vol63 else 0 end * 1e9, 4) as volatility_63, round(coalesce(day_drift, 0), 6) as day_drift from z left join bd using (entity_id)""")
def temporal_features(spark, d):
    f = mining.temporal_features(derived(spark, d), (3_600_000_000, DAY))
    at = lambda i, scale, n, name: F.round(F.col("features")[i] * scale, n).alias(name)
    return f.select("entity_id", F.size("features").alias("n_features"), at(0, 1e12, 4, "velocity_0"), at(63, 1e12, 4, "velocity_63"), at(64, 1.0, 6, "drift"), at(65, 1e9, 4, "volatility_0"), at(128, 1e9, 4, "volatility_63"), at(131, 1.0, 6, "day_drift"))


@query(f"""{PTS.replace('with ', 'with recursive ', 1)}, g as materialized (select entity_id, list(vector order by t, node_id) as vs, count(*)::int as n from pts group by 1), pr as materialized (select x.entity_id as a, y.entity_id as b, x.vs as va, y.vs as vb, x.n as n, y.n as m from g x join g y on y.entity_id = x.entity_id + 1 where x.entity_id % 2 = 1),
r as (select a, b, 0 as k, list_transform(range(1, n + 1), lambda i: case when i = 1 then list_distance(va[1], vb[1])::double else 'infinity'::double end) as cur, list_transform(range(1, n + 1), lambda i: 'infinity'::double) as prev from pr
union all select r.a, r.b, k + 1, list_transform(range(1, n + 1), lambda i: case when k + 3 - i between 1 and m then greatest(list_distance(va[i], vb[k + 3 - i])::double, least(cur[i], cur[i - 1], prev[i - 1])) else 'infinity'::double end), cur from r join pr using (a, b) where k < n + m - 2)
select a, b, round(cur[n], 6) as distance from r join pr using (a, b) where k = n + m - 2""")
def frechet(spark, d):
    p = derived(spark, d)
    return mining.frechet(p, _pairs(p)).withColumn("distance", F.round("distance", 6))


@query()
def granger(spark, d):
    p = derived(spark, d)
    g = mining.granger(p, _pairs(p), 3)
    return g.select("a", "b", "direction", "lag", F.round("f", 4).alias("f"), F.round("p", 6).alias("p"), F.round("effect", 4).alias("effect"), F.round(F.col("per_dimension_a_to_b")[0], 3).alias("f_a_to_b_0"))


@query()
def group_temporal_join(spark, d):
    g = mining.group_temporal_join(derived(spark, d), 0.9, 3, 2 * DAY)
    return g.select("start", "stop", F.size("entities").alias("n_entities"), F.round("mean_distance", 6).alias("mean_distance"))


@query()
def sliced_wasserstein(spark, d):
    """Each entity's region shares against those of all, over the vectors of all hubs of the level."""
    p = ingested(spark, d)
    h = regions.hubs(p, 2)
    return mining.region_transport(regions.assign(p, h), h, 20).withColumn("distance", F.round("distance", 6))


@query(f"{PTS} select node_id, round(vector[1] * exp(-1.0), 4) + 0 as y0, round(vector[64] * exp(-1.0), 4) + 0 as y63 from pts")
def ode_solutions(spark, d):
    """y' = -y from each vector over a time of one; SQL has the closed form."""
    rows = derived(spark, d).select("node_id", F.col("vector").alias("y0"), F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"))
    return mining.integrate(rows, lambda t, y: -y, "y0", "t0", "t1").select("node_id", (F.round(F.col("y")[0], 4) + 0.0).alias("y0"), (F.round(F.col("y")[63], 4) + 0.0).alias("y63"))


@query(f"{PTS} select node_id, round(vector[64] * 2 + 1, 6) as x, round(vector[1] * 2 + 1, 6) as z from pts")
def procrustes(spark, d):
    """Points against their mirrored, doubled and shifted copies; the fitted transform carries every point onto its copy."""
    p = derived(spark, d).withColumn("target", F.transform(F.reverse("vector"), lambda x: x * 2 + 1))
    fit = cohort.fit_procrustes(p, "vector", "target", 64)
    return cohort.apply_procrustes(p, "vector", fit).select("node_id", F.round(F.col("aligned")[0], 6).alias("x"), F.round(F.col("aligned")[63], 6).alias("z"))


@query(f"""{PTS}, z as (select entity_id, min(t) as first_t, max(t) as last_t, count(*) as n_points, arg_min(vector, struct_pack(a := t, b := node_id)) as v0, arg_max(vector, struct_pack(a := t, b := node_id)) as v1 from pts group by 1),
l as (select entity_id, list_distance(vector, lag(vector) over w) / nullif(t - lag(t) over w, 0) * 86400000000.0 as speed, lead(t) over w as later, lag(t) over w as p from pts window w as (partition by entity_id order by t, node_id)),
s as (select entity_id, coalesce(speed, 0) as speed from l where later is null and p is not null)
select entity_id, first_t, last_t, n_points, round(list_distance(v0, v1), 6) as drift, round(1 - list_inner_product(v0, v1) / (sqrt(list_inner_product(v0, v0)) * sqrt(list_inner_product(v1, v1))), 6) as drift_cosine, case when list_distance(v0, v1) < 0.1 then 'Minimal change' when list_distance(v0, v1) < 0.5 then 'Moderate drift' else 'Significant semantic shift' end as reading, round(list_max(list_transform(list_zip(v0, v1), lambda e: abs(e[1] - e[2]))), 6) as top_change, round(speed, 6) as speed from z join s using (entity_id)""")
def entity_summary(spark, d):
    """Without its change points, which change_points lists."""
    from vectide.plans.engine import entity_summaries

    s = entity_summaries(derived(spark, d))
    return s.select("entity_id", "first_t", "last_t", "n_points", F.round("drift", 6).alias("drift"), F.round("drift_cosine", 6).alias("drift_cosine"), "reading", F.round(F.abs(F.col("top_dimensions")[0]["change"]), 6).alias("top_change"), F.round("speed", 6).alias("speed"))


@query()
def entity_summary_text(spark, d):
    from vectide.plans.engine import entity_summaries

    return entity_summaries(derived(spark, d), 1.0).select("entity_id", "n_changes", "summary")


@query()
def anomaly_scan(spark, d):
    from vectide.plans.engine import anomaly_scan as scan

    return scan(derived(spark, d), 30 * DAY, penalty=1.0)


@query(PAIR_JOIN)
def compare_entities(spark, d):
    from vectide.plans.engine import compare_entities as compare

    c = compare(derived(spark, d), 1, 2, 1.1, 2 * DAY)
    return c.select("start", "stop", F.round("mean_distance", 6).alias("mean_distance"), F.round("min_distance", 6).alias("min_distance"), "n_windows")


@query()
def compare_causes(spark, d):
    from vectide.plans.engine import compare_causes as compare

    return compare(derived(spark, d), 1, 2).select("direction", "lag", F.round("f", 4).alias("f"), F.round("effect", 4).alias("effect"))


@query("""with m as (select node_id, metadata['model'] as model from ingestpoint where coalesce(metadata['model'], '') <> ''), c as (select node_id, (i - 1) % 8 as k, sum((ascii(substr(model, i, 1)) - 96) * 0.01) as x from m, range(1, 200) r(i) where i <= length(model) group by 1, 2), n as (select node_id, sqrt(sum(x * x)) as n from c group by 1)
select node_id, k as dim, round(case when n > 1e-8 then x / n else x end, 6) as value from c join n using (node_id)""")
def mock_embedding(spark, d):
    from vectide.sources.embed import embed

    p = table(spark, d, "ingestpoint").select("node_id", F.try_element_at("metadata", F.lit("model")).alias("model"))
    out = embed(p, "model", 8).where("embedding is not null").select("node_id", F.length("model").alias("n"), F.posexplode("embedding").alias("dim", "value"))
    return out.where("dim < n").select("node_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))
