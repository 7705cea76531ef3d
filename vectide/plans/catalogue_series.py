"""Trajectory calculus, joins in time and cohorts on points made of events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import distributions, vectors
from vectide.operators import cohort, joins
from vectide.operators import trajectory as tr
from vectide.plans.base import PTS, query
from vectide.session import micros, table
from vectide.sources.points import derived

T1, T2, T3 = 1704500000000000, 1705500000000000, 1706000000000000
DAY = 86_400_000_000


def _long(df: DataFrame, col: str, digits: int = 6) -> DataFrame:
    return df.select(*[c for c in df.columns if c != col], F.posexplode(col).alias("dim", "value")).withColumn("value", F.round("value", digits))


def _near(name: str, t: int) -> str:
    return f"{name} as (select entity_id, arg_min(vector, struct_pack(a := abs(t - {t}), b := t, c := node_id)) as v, arg_min(t, struct_pack(a := abs(t - {t}), b := t, c := node_id)) as t from pts group by 1)"


UNNEST = "unnest(range(0, 64))::int as dim"


@query(f"{PTS} select entity_id, node_id, t from pts where entity_id = 1")
def trajectory(spark, d):
    return tr.trajectory(derived(spark, d), 1).select("entity_id", "node_id", "t")


@query(f"""{PTS}, {_near('n', T1)} select entity_id, t from n""")
def nearest_in_time(spark, d):
    return tr.nearest_in_time(derived(spark, d), T1).select("entity_id", "t")


LINE = "line as (select *, row_number() over w as pos, count(*) over (partition by entity_id) as n, lag(vector) over w as v0, lead(vector) over w as v1, lag(t) over w as t0, lead(t) over w as t1 from pts window w as (partition by entity_id order by t, node_id))"


@query(f"""{PTS}, {LINE}, a as (select entity_id, arg_min(pos, struct_pack(a := abs(t - {T1}), b := t, c := node_id)) as pos from line group by 1),
x as (select l.entity_id, l.t, coalesce(v0, vector) as va, coalesce(v1, vector) as vb, coalesce(t1, t) - coalesce(t0, t) as dt from line l join a using (entity_id, pos) where n >= 2)
select entity_id, t, dim, round(case when dt = 0 then 0 else (vb[dim + 1] - va[dim + 1]) / dt * {DAY}.0 end, 6) as value from (select *, {UNNEST} from x)""")
def velocity(spark, d):
    return _long(tr.velocity(derived(spark, d), T1), "velocity")


@query(f"""{PTS}, {LINE}, a as (select entity_id, least(greatest(arg_min(pos, struct_pack(a := abs(t - {T1}), b := t, c := node_id)), 2), min(n) - 1) as pos from line group by 1),
x as (select l.entity_id, l.t, v0, vector, v1, (t - t0) / {DAY}.0 as d1, (t1 - t) / {DAY}.0 as d2 from line l join a using (entity_id, pos) where n >= 3)
select entity_id, t, dim, round(((v1[dim + 1] - vector[dim + 1]) / d2 - (vector[dim + 1] - v0[dim + 1]) / d1) / ((d1 + d2) / 2), 4) as value from (select *, {UNNEST} from x)""")
def acceleration(spark, d):
    return _long(tr.acceleration(derived(spark, d), T1), "acceleration", 4)


DIFF = f"{PTS}, {_near('a', T1)}, {_near('b', T2)}, m as (select entity_id, a.v as v1, b.v as v2, list_transform(list_zip(a.v, b.v), lambda z: z[2] - z[1]) as m from a join b using (entity_id))"
COSD = "(1 - greatest(-1, least(1, list_inner_product({0}, {1}) / (sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1}))))))"


@query(f"{DIFF} select entity_id, round(list_distance(v1, v2), 6) as l2, round({COSD.format('v1', 'v2')}, 6) as cosine from m")
def drift_report(spark, d):
    return tr.drift(derived(spark, d), T1, T2).select("entity_id", F.round("l2", 6).alias("l2"), F.round("cosine", 6).alias("cosine"))


@query(f"{DIFF} select entity_id, dim, round(abs(m[dim + 1]), 6) as change, round(coalesce(m[dim + 1] ** 2 / nullif(list_inner_product(m, m), 0), 0), 6) as share from (select *, {UNNEST} from m) qualify row_number() over (partition by entity_id order by abs(m[dim + 1]) desc, dim) <= 5")
def drift_attribution(spark, d):
    return tr.drift_attribution(derived(spark, d), T1, T2, 5).select("entity_id", "dim", F.round("change", 6).alias("change"), F.round("share", 6).alias("share"))


@query(f"{PTS}, {LINE} select entity_id, dim, round(case when t = t0 then vector[dim + 1] else vector[dim + 1] + (vector[dim + 1] - v0[dim + 1]) * ({T3 + 30 * DAY} - t) / (t - t0) end, 5) as value from (select *, {UNNEST} from line where t1 is null and t0 is not null)")
def prediction_linear(spark, d):
    return _long(tr.predict_linear(derived(spark, d), T3 + 30 * DAY), "prediction", 5)


@query(f"{PTS}, {_near('a', T1)}, {_near('b', T2)}, {_near('c', T3)} select dim, round(c.v[dim + 1] + b.v[dim + 1] - a.v[dim + 1], 6) as value from a, b, c, (select {UNNEST}) where a.entity_id = 1 and b.entity_id = 1 and c.entity_id = 2")
def analogy(spark, d):
    return _long(tr.analogy(derived(spark, d), 1, T1, T2, 2, T3), "analogy")


@query(f"{PTS}, {LINE} select entity_id, t, dim, round(abs(vector[dim + 1] - v0[dim + 1]), 6) as intensity from (select *, {UNNEST} from line where t0 is not null)")
def heatmap(spark, d):
    return tr.heatmap(derived(spark, d)).withColumn("intensity", F.round("intensity", 6))


@query(f"{PTS}, {LINE} select entity_id, dim, round(stddev_samp((vector[dim + 1] - v0[dim + 1]) / greatest(t - t0, 1)) * 1e9, 6) as volatility from (select *, {UNNEST} from line where t0 is not null) group by 1, 2 having count(*) >= 9")
def volatility(spark, d):
    return tr.realised_volatility(derived(spark, d)).withColumn("volatility", F.round(F.col("volatility") * 1e9, 6))


@query(f"""{PTS}, y as (select entity_id, t, node_id, value as y from pts), z as (select entity_id, y, lag(y) over (partition by entity_id order by t, node_id) as y0 from y),
s as (select entity_id, count(*) as m, regr_sxx(y - y0, y0) as sxx, regr_syy(y - y0, y0) as syy, regr_sxy(y - y0, y0) as sxy from z where y0 is not null group by 1 having count(*) >= 9)
select entity_id, round((sxy / sxx) / sqrt(((syy - sxy / sxx * sxy) / (m - 2)) / sxx), 5) as adf from s""")
def adf(spark, d):
    return tr.adf(derived(spark, d).withColumn("vector", F.array("value"))).withColumn("adf", F.round("adf", 5))


BUCKET = f"b as (select *, min(t) over (partition by entity_id) as t0, (t - min(t) over (partition by entity_id)) // {DAY} as bucket from pts)"
LAST = f"{BUCKET}, r as (select entity_id, bucket, min(t0) + bucket * {DAY} as t, arg_max(vector, struct_pack(a := t, b := node_id)) as v from b group by 1, 2)"


@query(f"{PTS}, {LAST} select entity_id, bucket, t, round(v[1], 6) as v0 from r")
def resample_last(spark, d):
    return tr.resample_last(derived(spark, d), DAY).select("entity_id", "bucket", "t", F.round(F.col("vector")[0], 6).alias("v0"))


@query(f"""{PTS}, g as (select entity_id, t0 + bucket * {DAY} + {DAY // 2} as t, bucket from (select entity_id, min(t) as t0, unnest(range(0, (max(t) - min(t)) // {DAY} + 1)) as bucket from pts group by 1)),
p as (select g.entity_id, bucket, g.t, arg_max(struct_pack(t := q.t, v := q.vector[1]), struct_pack(a := q.t, b := q.node_id)) filter (q.t <= g.t) as lo, arg_min(struct_pack(t := q.t, v := q.vector[1]), struct_pack(a := q.t, b := q.node_id)) filter (q.t > g.t) as hi from g join pts q using (entity_id) group by 1, 2, 3)
select entity_id, bucket, t, round(case when hi is null then lo.v else lo.v + (hi.v - lo.v) * (t - lo.t) / (hi.t - lo.t) end, 6) as v0 from p""")
def resample_linear(spark, d):
    return tr.resample_linear(derived(spark, d), DAY).select("entity_id", "bucket", "t", F.round(F.col("vector")[0], 6).alias("v0"))


@query(f"{PTS}, {LAST}, s as (select entity_id, t, v, lag(v) over (partition by entity_id order by bucket) as v0 from r) select entity_id, t, round(list_distance(v, v0), 6) as drift from s where v0 is not null")
def scale_drift(spark, d):
    return tr.scale_drift(derived(spark, d), DAY).withColumn("drift", F.round("drift", 6))


@query(f"""{PTS}, {LAST}, s as (select entity_id, t, list_distance(v, lag(v) over (partition by entity_id order by bucket)) as dr from r), n as (select entity_id, dr, row_number() over (partition by entity_id order by t) as i from s where dr is not null)
select round(coalesce(corr(a.dr, b.dr), 0), 6) as alignment from n a join n b using (i) where a.entity_id = 1 and b.entity_id = 2""")
def behavioural_alignment(spark, d):
    p = derived(spark, d)
    one = lambda e: tr.scale_drift(p.where(F.col("entity_id") == e), DAY).select("t", "drift")
    return tr.behavioural_alignment(one(1), one(2)).withColumn("alignment", F.round("alignment", 6))


@query(f"""{PTS}, g as (select entity_id, t, node_id, (t - lag(t) over (partition by entity_id order by t, node_id))::double as gap, min(t) over (partition by entity_id) as t0, max(t) over (partition by entity_id) as t1 from pts),
h as (select *, avg(gap) over (partition by entity_id) as mu, lead(gap) over (partition by entity_id order by t, node_id) as nxt, min(gap) over (partition by entity_id) as lo, max(gap) over (partition by entity_id) as hi from g),
k as (select entity_id, count(*) as n_events, (min(t1) - min(t0))::double as span, min(mu) as mean_gap, stddev_pop(gap) as std_gap, max(gap) as max_gap, sum((gap - mu) * (nxt - mu)) / sqrt(sum((gap - mu) ** 2) filter (nxt is not null) * sum((nxt - mu) ** 2) filter (gap is not null)) as memory,
 sqrt(avg(cos(2 * pi() * (t % {DAY}) / {DAY}.0)) ** 2 + avg(sin(2 * pi() * (t % {DAY}) / {DAY}.0)) ** 2) as circadian,
 sum(case when t < t1 then floor((t - t0) / ((t1 - t0) / 5.0)) - 2 end) / 10.0 as trend from h group by 1 having count(*) >= 3),
e as (select entity_id, sum(-n / tot * ln(n / tot)) as entropy from (select entity_id, count(*)::double as n, sum(count(*)) over (partition by entity_id)::double as tot from h where gap is not null group by entity_id, floor((gap - lo) / (hi - lo) * 9 + 0.5)) group by 1)
select entity_id, n_events, span, round(mean_gap, 2) as mean_gap, round(std_gap, 2) as std_gap, max_gap, round((std_gap - mean_gap) / (std_gap + mean_gap), 6) as burstiness, round(memory, 6) as memory, round(entropy, 6) as entropy, round(trend, 6) as trend, round(std_gap / mean_gap, 6) as gap_cv, round(circadian, 6) as circadian from k join e using (entity_id)""")
def event_features(spark, d):
    f = tr.event_features(derived(spark, d))
    return f.select("entity_id", "n_events", "span", F.round("mean_gap", 2).alias("mean_gap"), F.round("std_gap", 2).alias("std_gap"), "max_gap", *[F.round(c, 6).alias(c) for c in ("burstiness", "memory", "entropy", "trend", "gap_cv", "circadian")])


@query(f"{PTS} select entity_id, min(t) as first_seen, max(t) as last_seen, count(*) as n_points, max(t) - min(t) as duration from pts group by 1")
def entity_timeline(spark, d):
    return tr.timelines(derived(spark, d))


@query(f"{PTS}, g as (select *, coalesce((t - lag(t) over (partition by entity_id order by t, node_id)) / 1e6, 0) as gap from pts) select entity_id, node_id, round((t - min(t) over (partition by entity_id)) / coalesce(nullif(max(t) over (partition by entity_id) - min(t) over (partition by entity_id), 0), 1000000)::double, 6) as t_rel, round(gap, 3) as gap_seconds, round(ln(1 + gap), 6) as gap_log, row_number() over (partition by entity_id order by t, node_id) - 1 as post_index, (t % {DAY}) // 3600000000 as hour from g")
def post_features(spark, d):
    f = tr.post_features(derived(spark, d))
    return f.select("entity_id", "node_id", F.round("t_rel", 6).alias("t_rel"), F.round("gap_seconds", 3).alias("gap_seconds"), F.round("gap_log", 6).alias("gap_log"), "post_index", "hour")


@query(f"""{PTS}, g as (select entity_id, t, (t - lag(t) over (partition by entity_id order by t, node_id)) / 1e6 as gap, (t % {DAY}) // 3600000000 as h, row_number() over (partition by entity_id order by t, node_id) - 1 as i, count(*) over (partition by entity_id order by t // 1000000 range between unbounded preceding and 3600 following) as upto from pts)
select entity_id, count(*) as n_posts, round((max(t) - min(t)) / {DAY}.0, 6) as span_days, round(coalesce(avg(gap), 0), 4) as mean_gap, round(coalesce(stddev_pop(gap), 0), 4) as std_gap, round(coalesce(max(gap), 0), 4) as max_gap, round(coalesce(median(gap), 0), 4) as median_gap, round(case when count(gap) > 2 then regr_slope(gap, i) else 0 end, 3) as gap_trend, round(avg(case when h < 6 then 1.0 else 0.0 end), 6) as night_ratio, round(avg(case when h >= 18 then 1.0 else 0.0 end), 6) as evening_ratio, count(*) filter (upto - i >= 5) as bursts, round(coalesce(stddev_pop(gap) / nullif(avg(gap), 0), 0), 6) as cv_gap from g group by 1""")
def behaviour_features(spark, d):
    f = tr.behaviour_features(derived(spark, d))
    return f.select("entity_id", "n_posts", "bursts", F.round("gap_trend", 3).alias("gap_trend"), *[F.round(c, 4).alias(c) for c in ("mean_gap", "std_gap", "max_gap", "median_gap")], *[F.round(c, 6).alias(c) for c in ("span_days", "night_ratio", "evening_ratio", "cv_gap")])


@query("""with r as (select o.o_custkey % 3 as k, o.o_orderkey as t, o.o_totalprice::double as price, (o.o_orderkey % 100 + 1)::double as volume, (o.o_orderkey % 37 + 20)::double as bench from orders o),
l as (select *, ln(price / lag(price) over w) as lr, row_number() over w as i, price / lag(price, 5) over w - 1 as ret_5, price / lag(price, 20) over w - 1 as ret_20, price / lag(price, 60) over w - 1 as ret_60, (price / lag(price, 20) over w - 1) - (bench / lag(bench, 20) over w - 1) as rel_strength, volume / avg(volume) over (partition by k order by t rows between 19 preceding and current row) as volume_ratio from r window w as (partition by k order by t)),
m as (select *, stddev_samp(lr) over (partition by k order by t rows between 4 preceding and current row) * sqrt(252) as vol_5, stddev_samp(lr) over (partition by k order by t rows between 19 preceding and current row) * sqrt(252) as vol_20 from l)
select k, t, round(ret_5, 5) as ret_5, round(ret_20, 5) as ret_20, round(ret_60, 5) as ret_60, round(vol_5, 5) as vol_5, round(vol_20, 5) as vol_20, round(rel_strength, 5) as rel_strength, round(volume_ratio, 5) as volume_ratio from m where i > 60""")
def sector_features(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 3).alias("k"), F.col("o_orderkey").alias("t"), F.col("o_totalprice").cast("double").alias("price"), (F.col("o_orderkey") % 100 + 1).cast("double").alias("volume"), (F.col("o_orderkey") % 37 + 20).cast("double").alias("benchmark"))
    f = tr.sector_features(o, "k", "t", "price", "volume")
    return f.select("k", "t", *[F.round(c, 5).alias(c) for c in f.columns[2:]])


@query(f"select user_id as entity_id, epoch_us(ts) // {DAY} as day, count(*) as n_events, count(*) filter (event_type = 'view') as n_view, count(*) filter (event_type = 'error') as n_error, round(avg(case when hour(ts) < 7 or hour(ts) >= 19 then 1.0 else 0.0 end), 6) as after_hours_ratio from events group by 1, 2")
def daily_activity(spark, d):
    e = table(spark, d, "events")
    return tr.daily_activity(e.withColumn("t_us", micros(e, "ts")), "user_id", "t_us", "event_type", ["view", "error"]).withColumn("after_hours_ratio", F.round("after_hours_ratio", 6))


@query(f"""{PTS}, u as (select entity_id, t, list_transform(vector, lambda x: x / sqrt(list_inner_product(vector, vector))) as u, row_number() over (partition by entity_id order by t, node_id) as i from pts)
select a.entity_id, a.i, a.t, round(1 - avg(list_inner_product(x.u, y.u)), 6) as dispersion from u a join u x on x.entity_id = a.entity_id and x.i between a.i and a.i + 29 join u y on y.entity_id = a.entity_id and y.i between a.i and a.i + 29 and y.i <> x.i where (a.i - 1) % 5 = 0 group by 1, 2, 3 having count(*) = 870""")
def dispersion_timeline(spark, d):
    return tr.dispersion_timeline(derived(spark, d)).select("entity_id", "i", "t", F.round("dispersion", 6).alias("dispersion"))


WIN = 2 * DAY


@query(f"""{PTS}, pr as (select entity_id as a, entity_id + 1 as b from (select distinct entity_id from pts) where entity_id % 2 = 1),
l as (select a, b, t, vector from pr join pts on entity_id = a), r as (select a, b, t, vector from pr join pts on entity_id = b),
bd as (select a, b, min(t) as lo, max(t) as hi from (select * from l union all select * from r) group by 1, 2),
w as (select a, b, lo, hi, win, lo + win * {WIN // 2} as s, least(lo + win * {WIN // 2} + {WIN}, hi) as e from (select *, unnest(range(0, (hi - lo) // {WIN // 2} + 1)) as win from bd)),
c as (select w.a, w.b, win, lo, hi, min(list_distance(l.vector, r.vector)) as mn, avg(list_distance(l.vector, r.vector)) as av, count(distinct l.t) as na, count(distinct r.t) as nb from w join l on l.a = w.a and l.t between s and e join r on r.a = w.a and r.t between s and e group by all having min(list_distance(l.vector, r.vector)) <= 1.1),
k as (select *, win - row_number() over (partition by a, b order by win) as run from c)
select a, b, min(lo) + min(win) * {WIN // 2} as start, least(min(lo) + max(win) * {WIN // 2} + {WIN}, max(hi)) as stop, round(avg(av), 6) as mean_distance, round(min(mn), 6) as min_distance, max(na) as points_a, max(nb) as points_b from k group by a, b, run""")
def temporal_join(spark, d):
    p = derived(spark, d)
    pairs = p.select(F.col("entity_id").alias("a")).distinct().where("a % 2 = 1").withColumn("b", F.col("a") + 1)
    j = joins.temporal_join(pairs, p, 1.1, WIN)
    return j.withColumn("mean_distance", F.round("mean_distance", 6)).withColumn("min_distance", F.round("min_distance", 6))


@query(f"""{PTS}, b as (select min(t) as lo, max(t) as hi from pts), w as (select lo + i * {WIN // 2} as start, least(lo + i * {WIN // 2} + {WIN}, hi) as stop from (select lo, hi, unnest(range(0, (hi - lo) // {WIN // 2} + 1)) as i from b))
select start, stop, entity_id, round(avg(vector[1]), 6) as c0, round(avg(vector[64]), 6) as c63 from w join pts on t between start and stop group by 1, 2, 3""")
def window_centroids(spark, d):
    c = joins.window_centroids(derived(spark, d), WIN)
    return c.select("start", "stop", "entity_id", F.round(F.col("centroid")[0], 6).alias("c0"), F.round(F.col("centroid")[63], 6).alias("c63"))


@query(f"""{PTS}, n as (select count(*) filter (entity_id = 1) >= count(*) filter (entity_id = 2) as lead from pts), g as (select t, vector[1] as g, node_id, case when lead then 2 else 1 end as o, lead from pts, n where entity_id = case when lead then 1 else 2 end),
p as (select g.t, g.node_id, any_value(g) as g, any_value(lead) as lead, arg_max(struct_pack(t := q.t, v := q.vector[1]), struct_pack(a := q.t, b := q.node_id)) filter (q.t <= g.t) as lo, arg_min(struct_pack(t := q.t, v := q.vector[1]), struct_pack(a := q.t, b := q.node_id)) filter (q.t >= g.t) as hi from g join pts q on q.entity_id = g.o group by 1, 2),
s as (select t, g, lead, case when lo is null then hi.v when hi is null or hi.t = lo.t then lo.v else lo.v + (hi.v - lo.v) * (t - lo.t) / (hi.t - lo.t) end as o from p)
select t, round(case when lead then g else o end, 6) as a0, round(case when lead then o else g end, 6) as b0 from s""")
def align_pair(spark, d):
    return joins.align(derived(spark, d), 1, 2).select("t", F.round(F.col("va")[0], 6).alias("a0"), F.round(F.col("vb")[0], 6).alias("b0"))


MEANS = "c as (select list(avg1 order by i) as c1, list(avg2 order by i) as c2, list(avgm order by i) as cm from (select i, avg(v1[i]) as avg1, avg(v2[i]) as avg2, avg(m[i]) as avgm from m, range(1, 65) r(i) group by i))"


@query(f"""{DIFF}, {MEANS} select count(*) as n_entities, round(avg(list_distance(v1, v2)), 6) as mean_drift, round(median(list_distance(v1, v2)), 6) as median_drift, round(stddev_samp(list_distance(v1, v2)), 6) as std_drift, round(any_value(list_distance(c1, c2)), 6) as centroid_l2, round(any_value({COSD.format('c1', 'c2')}), 6) as centroid_cosine,
round(avg(list_distance(v1, c1)), 6) as dispersion_t1, round(avg(list_distance(v2, c2)), 6) as dispersion_t2, round(avg(list_distance(v2, c2)) - avg(list_distance(v1, c1)), 6) as dispersion_change, round(avg(list_inner_product(m, cm) / nullif(sqrt(list_inner_product(m, m)) * sqrt(list_inner_product(cm, cm)), 0)), 6) as convergence from m, c""")
def cohort_drift(spark, d):
    c = cohort.cohort_drift(derived(spark, d), T1, T2).drop("top")
    return c.select("n_entities", *[F.round(x, 6).alias(x) for x in c.columns[1:]])


@query(f"{DIFF}, {MEANS}, s as (select avg(list_distance(v1, v2)) as mu, stddev_samp(list_distance(v1, v2)) as sd from m) select entity_id, round(list_distance(v1, v2), 6) as drift, round((list_distance(v1, v2) - mu) / sd, 6) as z_score, round(1 - {COSD.format('m', 'cm')}, 6) as alignment from m, c, s where abs((list_distance(v1, v2) - mu) / sd) > 2")
def cohort_outliers(spark, d):
    o = cohort.cohort_outliers(derived(spark, d), T1, T2)
    return o.select("entity_id", *[F.round(x, 6).alias(x) for x in o.columns[1:]])


CF = f"""{PTS}, l as (select entity_id, t, (t - {T2}) / {DAY}.0 as x, i as dim, vector[i] as y from pts, range(1, 65) r(i)),
f as (select entity_id, dim, coalesce(regr_slope(y, x), 0) as s, avg(y) as ym, avg(x) as xm from l where t <= {T2} group by 1, 2),
k as (select l.entity_id, t, sqrt(sum((y - (ym + s * (x - xm))) ** 2)) as dv from l join f using (entity_id, dim) where t >= {T2} group by 1, 2)"""


@query(f"{CF} select entity_id, t, round(dv, 6) as divergence from k")
def counterfactual(spark, d):
    return cohort.counterfactual(derived(spark, d), T2).withColumn("divergence", F.round("divergence", 6))


@query(f"{CF}, a as (select *, (dv + lag(dv) over w) / 2 * (t - lag(t) over w) / {DAY}.0 as area from k window w as (partition by entity_id order by t)) select entity_id, round(coalesce(sum(area), 0), 5) as total_divergence, round(max(dv), 6) as max_divergence, arg_max(t, struct_pack(a := dv, b := t)) as max_t from a group by 1")
def counterfactual_summary(spark, d):
    c = cohort.counterfactual_summary(derived(spark, d), T2)
    return c.select("entity_id", F.round("total_divergence", 5).alias("total_divergence"), F.round("max_divergence", 6).alias("max_divergence"), "max_t")


def _shares(spark, d):
    """Each user's shares of event types, beside those of all users."""
    e = table(spark, d, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    part = lambda: F.array(*[F.count_if(F.col("event_type") == k) / F.count(F.lit(1)) for k in kinds])
    return e.groupBy("user_id").agg(part().alias("p")).crossJoin(F.broadcast(e.agg(part().alias("q"))))


SH = "with k as (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as kind, unnest(range(5)) as i), p as (select user_id, i, count(*) filter (event_type = kind) / count(*) as p from events, k group by 1, 2), q as (select i, count(*) filter (event_type = kind) / count(*) as q from events, k group by 1), j as (select *, sum(p - q) over (partition by user_id order by i) as c from p join q using (i))"


@query(f"{SH} select user_id, round(sum(sqrt(p * q)), 6) as bhattacharyya, round(2 * acos(least(1.0, sum(sqrt(p * q)))), 5) as fisher_rao, round(sqrt(greatest(1 - sum(sqrt(p * q)), 0) / 2), 5) as hellinger, round(sum(abs(c)), 6) as wasserstein from j group by 1")
def distribution_distances(spark, d):
    s = _shares(spark, d)
    return s.select("user_id", F.round(distributions.bhattacharyya("p", "q"), 6).alias("bhattacharyya"), F.round(distributions.fisher_rao("p", "q"), 5).alias("fisher_rao"), F.round(distributions.hellinger("p", "q"), 5).alias("hellinger"), F.round(distributions.wasserstein_1d("p", "q"), 6).alias("wasserstein"))


@query(f"{SH} select user_id, i as dim, round(exp(p) / sum(exp(p)) over (partition by user_id), 6) as share from j")
def softmax(spark, d):
    return _shares(spark, d).select("user_id", F.posexplode(vectors.softmax("p")).alias("dim", "share")).select("user_id", F.col("dim").cast("long").alias("dim"), F.round("share", 6).alias("share"))
