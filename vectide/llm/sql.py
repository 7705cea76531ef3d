"""DuckDB SQL of the queries that SQL can express on whole tables."""

SQL = {
    "p3_found": """
with recursive e as (select user_id_a as a, user_id_b as b from subject_link where user_id_a is not null and user_id_b is not null union select user_id_b, user_id_a from subject_link where user_id_a is not null and user_id_b is not null),
r as (select a as n, a as m from e union select r.n, e.b from r join e on r.m = e.a),
c as (select n, min(m) as root from r group by n),
h as (select distinct user_id, split from erisk_mental_embeddings where user_id is not null and split is not null),
g as (select h.user_id, h.split, coalesce(c.root, h.user_id) as grp from h left join c on h.user_id = c.n)
select distinct user_id from g where grp in (select grp from g group by grp having count(distinct split) > 1)""",
    "p10_found": """
with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from documents),
k as (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 6),
g as (select doc_id, i, row_number() over (partition by doc_id, ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4] order by i) as nth from k),
h as (select distinct doc_id, i + j as pos from g, range(0, 5) t(j) where nth > 1)
select h.doc_id from h join w using (doc_id) group by h.doc_id having count(*) >= 0.3 * any_value(len(ws))""",
}

_VECTORS = """
with r as (select sequence, any_value(vector)::double[] as v from ingestpoint group by sequence),
u as (select sequence, v from r where v is not null and len(v) = 64 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
p as (select a.sequence as a, b.sequence as b, round(65536 * (list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v))) / 65536 as d2 from u a join u b on a.sequence <> b.sequence),
n as (select * from p where d2 <= 0.30)
"""
SQL["p4_found"] = _VECTORS + """, t as (select *, row_number() over (partition by a order by d2, b) as place from n)
select distinct least(a, b) as sequence_a, greatest(a, b) as sequence_b from t where place <= 5"""
SQL["p4_knn"] = _VECTORS + """, t as (select *, row_number() over (partition by a order by d2, b) as place from p where a % 100 = 0)
select t.a as sequence, t.b as neighbour, e.entity_id, t.d2 from t join (select sequence, min(entity_id) as entity_id from ingestpoint group by sequence) e on e.sequence = t.b where place <= 5"""
SQL["p6_found"] = _VECTORS + """, s as (select a, list_sort(list_append(list(b), a)) as near from n group by a),
bad as (select n.a from n join s x on x.a = n.a join s y on y.a = n.b where x.near <> y.near)
select a as sequence, near[1] as cluster_key from s where a not in (select a from bad)"""

_BAD = SQL["p6_found"][: SQL["p6_found"].rindex("select a as sequence")]
SQL["p6_clusters"] = _BAD.rstrip() + """, m as (select a as sequence, near[1] as k from s where a not in (select a from bad)),
e as (select k, v, min(m.sequence) as rep, count(*) as n from m join u using (sequence) group by k, v),
c as (select k, i, sum(v[i] * n) / sum(n) as x from e, range(1, 65) r(i) group by k, i), w as (select k, list(x order by i) as c from c group by k),
o as (select e.k, rep, n, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) ** 2)) as off from e join w using (k)),
t as (select *, row_number() over (partition by k order by round(off, 9), rep) as place from o)
select k as cluster_key, sum(n)::bigint as n_records, min(rep) filter (place = 1) as medoid, string_agg(rep::varchar, ',' order by place) filter (place <= 3) as typical, round(sqrt(max(off)), 6) as radius from t group by k"""

SQL["p7_found"] = """
with s as (select post_id, min(split) as split from erisk_mental_embeddings where split is not null group by post_id),
w as (select u.post_id, any_value(s.split) as split, any_value(regexp_extract_all(lower(u.text), '[\\p{L}\\p{N}]+')) as ws from unified u join s using (post_id) where u.text is not null group by u.post_id),
g as (select post_id, split, unnest(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) as sh from w where len(ws) >= 20),
n as (select post_id, count(*) as n from g group by post_id),
b as (select a.post_id as x, e.post_id as y, count(*) as common from g a join g e on a.sh = e.sh where a.split = 'train' and e.split in ('val', 'test') group by all)
select least(x, y) as post_id_a, greatest(x, y) as post_id_b from b join n p on p.post_id = x join n q on q.post_id = y where common >= 0.5 * (p.n + q.n - common)"""

_PAIRS = SQL["p7_found"][: SQL["p7_found"].rindex("select least(x, y)")]
SQL["p7_report"] = _PAIRS.rstrip() + """,
h as (select x, y, common, p.n + q.n - common as whole from b join n p on p.post_id = x join n q on q.post_id = y where common >= 0.5 * (p.n + q.n - common)),
o as (select post_id, min(source) as source from unified group by 1)
select s.split, o.source, count(distinct y) as n_posts, count(*)::bigint as n_pairs, count(*) filter (common = whole)::bigint as n_equal_pairs from h join s on s.post_id = y join o on o.post_id = y group by 1, 2"""
