"""Edge cases of the DataFrame operators: nulls, ties, zero vectors, empty tables, single points, round trips."""

import json
import tarfile
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import distributions, episodes, scoring, vectors
from vectide.functions.filters import MetadataFilter, TemporalFilter
from vectide.kernels import changes
from vectide.operators import cohort, features, graph, joins, learning, lsh, mining, regions, search, storage
from vectide.operators import trajectory as tr
from vectide.operators.search import SearchSpec
from vectide.plans import engine
from vectide.sources import embed, files
from vectide.sources.points import ingested, split_valid

POINT = "node_id long, entity_id long, t long, vector array<double>, reward double, metadata map<string,string>"


def points(spark, rows):
    return spark.createDataFrame([(i, e, t, v, r, m) for i, (e, t, v, r, m) in enumerate(rows)], POINT)


def grid(spark, entities=5, n=20, dim=4):
    return points(spark, [(e, i * 1_000_000, [10 * e + 0.1 * i + 0.01 * d for d in range(dim)], i / n if i % 3 else None, {"i": str(i)}) for e in range(entities) for i in range(n)])


def one(df):
    return df.first()


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = one(df.select(vectors.l2("a", "b").alias("l2"), vectors.cosine_distance("a", "b").alias("c"), vectors.cosine_distance("a", "z").alias("cz"), vectors.dot_distance("a", "a").alias("d"), vectors.top_dims(F.array(F.lit(1.0), F.lit(-1.0), F.lit(2.0)), 2).alias("top")))
    assert abs(r["l2"] - 2**0.5) < 1e-12 and r["c"] == 1.0 and r["cz"] == 1.0 and r["d"] == -1.0
    assert [(x["dim"], x["change"]) for x in r["top"]] == [(2, 2.0), (0, 1.0)]
    d = one(df.select(distributions.fisher_rao("a", "b").alias("f"), distributions.hellinger("a", "b").alias("h"), distributions.wasserstein_1d("a", "b").alias("w"), distributions.fisher_rao("a", "a").alias("s")))
    assert abs(d["f"] - np.pi) < 1e-12 and abs(d["h"] - 0.5**0.5) < 1e-12 and d["w"] == 1.0 and d["s"] == 0.0


def test_episode_codes(spark):
    df = spark.createDataFrame([(7, 3), (0, 65536), (-1, 2)], "e long, s long")
    got = [r["p"] for r in df.select(episodes.encode(F.col("e"), F.col("s")).alias("p")).collect()]
    assert got == [7 << 16 | 3, None, None] and episodes.episode_range(7) == (7 << 16, 7 << 16 | 65535)


def test_filters(spark):
    p = points(spark, [(1, 10, [1.0], None, {"a": "x1", "n": "5"}), (1, 20, [1.0], None, {"a": "x2", "n": "zz"}), (1, 30, [1.0], None, None)])
    ids = lambda c: [r["node_id"] for r in p.where(c).orderBy("node_id").collect()]
    assert ids(TemporalFilter.before(20).column()) == [0, 1] and ids(TemporalFilter.after(20).column()) == [1, 2] and ids(TemporalFilter.snapshot(20).column()) == [1]
    assert ids(MetadataFilter().contains("a", "x").column()) == [0, 1] and ids(MetadataFilter().gte("n", 5).column()) == [0]
    assert ids(MetadataFilter().column()) == [0, 1, 2] and ids(~MetadataFilter().exists("n").column()) == [2]
    assert ids(MetadataFilter().equals("a", "x1").equals("a", "x2").column()) == [1]


def test_snapshot_range_and_trajectory(spark):
    p = grid(spark)
    q = [0.0] * 4
    got = engine.execute(p, engine.SnapshotKnn(q, 5_000_000, 3)).collect()
    assert [r["entity_id"] for r in got] == [0, 1, 2] and {r["t"] for r in got} == {5_000_000}
    assert all(2_000_000 <= r["t"] <= 4_000_000 for r in engine.execute(p, engine.RangeKnn(q, 2_000_000, 4_000_000, 50, 0.5)).collect())
    line = [r["t"] for r in engine.execute(p, engine.Trajectory(2)).collect()]
    assert len(line) == 20 and line == sorted(line)
    assert engine.execute(p, engine.Trajectory(99)).count() == 0
    with pytest.raises(ValueError):
        engine.execute(p, object())


def test_every_typed_query_runs(spark):
    p = grid(spark, 3)
    q = [0.0] * 4
    for x in (engine.Velocity(1, 0), engine.Prediction(1, 10**8), engine.ChangePoints(1, 0, 10**9), engine.Drift(1, 0, 10**7), engine.Analogy(0, 0, 10**6, 1, 0), engine.Counterfactual(1, 10**7), engine.Granger(0, 1, 2), engine.Motifs(1, 3), engine.Discords(1, 3), engine.TemporalJoin(0, 1, 50.0, 4_000_000), engine.CohortDrift([0, 1, 2], 0, 10**7), engine.CausalSearch(q, 2)):
        engine.execute(p, x).collect()


def test_search_ties_pool_reward_empty(spark):
    p = points(spark, [(1, 5, [1.0, 0.0], 0.9, None), (1, 5, [1.0, 0.0], float("nan"), None), (2, 5, [0.0, 1.0], None, None)])
    assert [r["node_id"] for r in search.nearest(p, SearchSpec([1.0, 0.0], 2)).collect()] == [0, 1]
    assert [r["node_id"] for r in search.nearest(p, SearchSpec([1.0, 0.0], 5, min_reward=0.1)).collect()] == [0]
    assert search.nearest(p.where("false"), SearchSpec([1.0, 0.0], 2)).count() == 0
    assert {(r["query"], r["node_id"]) for r in search.batch_nearest(p, [[1.0, 0.0], [0.0, 1.0]], 1).collect()} == {(0, 0), (1, 2)}
    with pytest.raises(ValueError):
        search.batch_nearest(p, [[0.0, 0.0]] * 10_001, 1)


def test_weights_learn():
    w = scoring.Weights(1.0, 0.5).learn({"similarity": 1.0, "recency": 1.0}, 1.0, 0)
    assert w.similarity < 1.0 and w.recency < 0.5
    assert scoring.Weights(2.0).learn({"similarity": 100.0}, 0.0, 0).similarity == 2.0


def test_velocity_prediction_ramp(spark):
    p = points(spark, [(1, i * 1_000_000, [0.1 * i, 0.1 * (20 - i), 0.5], None, None) for i in range(20)])
    v = one(tr.velocity(p, 7_000_000, 1e6))["velocity"]
    assert np.allclose(v, [0.1, -0.1, 0])
    assert np.allclose(one(tr.predict_linear(p, 25_000_000))["prediction"], [2.5, -0.5, 0.5])
    assert np.allclose(one(tr.acceleration(p, 0, 1e6))["acceleration"], 0)
    assert tr.velocity(p.limit(1), 0).count() == 0 and tr.acceleration(p.where("t <= 1000000"), 0).count() == 0


def test_equal_times_give_zero_velocity(spark):
    p = points(spark, [(1, 5, [1.0], None, None), (1, 5, [2.0], None, None)])
    assert one(tr.velocity(p, 5))["velocity"] == [0.0]
    assert one(tr.predict_linear(p, 9))["prediction"] == [2.0]


def test_temporal_join_far_and_equal(spark):
    rows = lambda a, b: [(e, t, [x, x], None, None) for e, x in ((1, a), (2, b)) for t in (1000, 2000, 3000)]
    pair = spark.createDataFrame([(1, 2)], "a long, b long")
    assert joins.temporal_join(pair, points(spark, rows(0.0, 100.0)), 0.5, 2000).count() == 0
    got = joins.temporal_join(pair, points(spark, rows(1.0, 1.0)), 0.5, 5000).collect()
    assert [(r["start"], r["stop"], r["mean_distance"], r["points_a"]) for r in got] == [(1000, 3000, 0.0, 3)]


def test_group_join_finds_the_group(spark):
    p = points(spark, [(e, t, [x, 0.0], None, None) for e, x in ((1, 0.0), (2, 0.1), (3, 9.0)) for t in range(0, 10_000, 1000)])
    got = mining.group_temporal_join(p, 0.5, 2, 4000).collect()
    assert len(got) == 1 and got[0]["entities"] == [1, 2] and got[0]["start"] == 0


def test_cohort_uniform_shift_and_single(spark):
    p = points(spark, [(e, t, [e + (5.0 if t else 0.0), 1.0], None, None) for e in range(4) for t in (0, 100)])
    r = one(cohort.cohort_drift(p, 0, 100))
    assert abs(r["convergence"] - 1) < 1e-12 and abs(r["std_drift"]) < 1e-12 and abs(r["dispersion_change"]) < 1e-12
    assert cohort.cohort_drift(p.where("entity_id = 1"), 0, 100).count() == 0
    far = p.unionByName(points(spark, [(9, 0, [0.0, 0.0], None, None), (9, 100, [500.0, 0.0], None, None)]))
    assert [x["entity_id"] for x in cohort.cohort_outliers(far, 0, 100, 1.5).collect()] == [9]


def test_counterfactual_line(spark):
    p = points(spark, [(1, i * 86_400_000_000, [float(i)], None, None) for i in range(10)])
    assert one(cohort.counterfactual_summary(p, 5 * 86_400_000_000))["total_divergence"] < 1e-6


def test_regions_and_anchors(spark):
    p = points(spark, [(1, i, [float(i), 0.0], None, None) for i in range(33)])
    h = regions.hubs(p, 1)
    a = regions.assign(p, h)
    assert {r["node_id"]: r["hub"] for r in a.collect()}[8] == 0  # a tie goes to the lower hub
    assert sum(r["n_members"] for r in regions.region_counts(a, h).collect()) == 33
    s = regions.anchor_summary(regions.project_to_anchors(points(spark, [(1, 0, [0.6, 0.0], None, None), (1, 1, [0.2, 0.0], None, None)]), [[0.0, 0.0]], "l2")).first()
    assert abs(s["mean"] - 0.4) < 1e-12 and s["min"] == 0.2 and abs(s["trend"] + 0.4) < 1e-12 and s["last"] == 0.2


def test_procrustes_rotation(spark):
    rng = np.random.default_rng(0)
    x, (u, _, v) = rng.standard_normal((40, 3)), np.linalg.svd(rng.standard_normal((3, 3)))
    y = 2 * x @ (u @ v) + 1
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "vector array<double>, y array<double>")
    fit = cohort.fit_procrustes(df, "vector", "y", 3)
    assert abs(fit["scale"] - 2) < 1e-9 and fit["error"] < 1e-6
    assert cohort.fit_procrustes(df.where("false"), "vector", "y", 3) is None


def test_graph_rules(spark):
    e = spark.createDataFrame([(1, 2, "a", 0.5), (2, 3, "a", 0.5), (1, 3, "a", 0.1), (3, 1, "a", 1.0), (1, 1, "a", 1.0), (None, 2, "a", 1.0), (2, 4, None, None)], "source long, target long, edge_type string, weight double")
    start = spark.createDataFrame([(1,)], "start long")
    assert {(r["node"], r["weight"]) for r in graph.traverse(e, start, None, 2).collect()} == {(2, 0.5), (3, 0.25)}
    assert {(r["node"], r["hop"]) for r in graph.reach(e, start, None, 2).collect()} == {(2, 1), (3, 1), (4, 2)}
    assert one(graph.find_path(e, 1, 4, 3))["path"] == [1, 2, 4] and graph.find_path(e, 4, 1, 3).count() == 0
    need = spark.createDataFrame([("open", "key"), ("open", "door"), ("wait", "time")], "action string, fact string")
    acts = spark.createDataFrame([("open",), ("wait",), ("rest",)], "action string")
    state = spark.createDataFrame([("key",), ("time",)], "fact string")
    assert {r["action"] for r in graph.valid_actions(acts, need, state).collect()} == {"wait", "rest"}
    assert graph.apply_action(state, spark.createDataFrame([("key",), ("door",)], "fact string")).count() == 3


def test_mdp_fixture(spark):
    ep = spark.createDataFrame([(1, 0, 0, "n", 1.0), (1, 1, 1, "n", 1.0), (1, 2, 2, None, 1.0), (2, 0, 0, "n", 0.0), (2, 1, 1, "n", 0.0), (2, 2, 3, None, 0.0)], "episode_id long, step int, region int, action string, reward double")
    assert {(r["region"], r["action"]): r["success"] for r in learning.action_success(ep).collect()}[(0, "n")] == 0.5
    assert sum(r["n"] for r in learning.transitions(ep).collect()) == 4
    asked = spark.createDataFrame([(0, "n"), (2, "x"), (9, "x")], "region int, action string")
    assert {r["region"]: r["success"] for r in learning.success_or_default(ep, asked).collect()} == {0: 0.5, 2: 1.0, 9: 0.5}


def test_network_modes(spark):
    rows = spark.createDataFrame([("a", "x")] * 3 + [("b", "y")] * 3 + [(None, "x")], "p string, c string")
    net = learning.Network({"p": ["a", "b"], "c": ["x", "y"]}, {"c": ["p"]})
    net.learn(rows)
    post = {r["state"]: r["probability"] for r in net.posterior("p", {"c": "y"}).collect()}
    assert abs(sum(post.values()) - 1) < 1e-12 and post["b"] > post["a"]
    assert one(net.most_likely("p", {"c": "y"}))["state"] == "b"


def test_metrics_and_bootstrap(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1), (None, 0.5)], "y int, s double")
    m = one(learning.binary_metrics(df, "y", "s"))
    assert m["n"] == 4 and abs(m["auc"] - 0.625) < 1e-12 and abs(m["precision"] - 2 / 3) < 1e-12 and m["recall"] == 1.0
    assert one(learning.binary_metrics(df.where("false"), "y", "s"))["auc"] is None
    b = one(learning.bootstrap_mean(spark.range(1000).selectExpr("id % 10 as x"), "x", 50))
    assert b["low"] < 4.5 < b["high"]


def test_bootstrap_of_metrics(spark):
    df = spark.range(600).selectExpr("id as k", "cast(id % 3 = 0 as int) as y", "case when id % 3 = 0 then 0.5 + (id % 7) / 20.0 else (id % 11) / 15.0 end as s", "1 as round")
    m = {r["metric"]: r for r in learning.bootstrap_metrics(df, "y", "s", "k", 30).collect()}
    whole = one(learning.binary_metrics(df, "y", "s"))
    assert all(m[c]["low"] <= whole[c] <= m[c]["high"] for c in ("auc", "precision", "f1")) and set(m) == {"auc", "precision", "recall", "f1"}
    assert learning.bootstrap_metrics(df.where("false"), "y", "s", "k", 3).count() == 0


def test_stratified_ranges(spark):
    df = spark.range(5000).selectExpr("id as u", "case when id % 10 = 0 then null when id % 3 = 0 then 'a' else 'b' end as l", "1 as n")
    got = {(r["label"], r["split"]): r["count"] for r in learning.stratified_split(df.unionByName(df), "u", "l").groupBy("label", "split").count().collect()}
    for label, n in ((None, 500), ("a", 1500), ("b", 3000)):
        assert got[label, "train"] == 0.8 * n and got[label, "test"] == n - 0.8 * n


def test_diverse_has_no_bound(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 3))
    s = (x**2).sum(1)
    df = spark.createDataFrame([(i, float(s[i]), v.tolist(), 1) for i, v in enumerate(x)], "node_id long, score double, vector array<double>, taken int")
    want: list[int] = []
    for i in np.lexsort((np.arange(400), s)):
        if len(want) < 6 and all(((x[i] - x[j]) ** 2).sum() > s[i] for j in want):
            want.append(int(i))
    assert [r["node_id"] for r in search.diverse(df, 6).orderBy("score").collect()] == want
    assert search.diverse(df.where("false"), 3).count() == 0


def test_regions_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((60, 4)), 2)
    p = points(spark, [(i % 3, i, v.tolist(), None, None) for i, v in enumerate(x)])
    h = p.where("node_id % 2 = 0").select(F.col("node_id").alias("hub"), F.col("vector").alias("hub_vector"))
    whole = {r["node_id"]: (r["hub"], round(r["hub_distance"], 9)) for r in regions.assign(p, h).collect()}
    monkeypatch.setattr(regions, "MOST_HUBS", 16)
    cut = {r["node_id"]: (r["hub"], round(r["hub_distance"], 9)) for r in regions.assign(p, h).collect()}
    d = ((x[:, None] - x[None, ::2]) ** 2).sum(-1)
    assert whole == cut == {i: (int(2 * d[i].argmin()), round(float(d[i].min()), 9)) for i in range(60)}


def test_batch_search_by_every_metric(spark):
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((500, 6)), rng.standard_normal((7, 6))
    x[3], x[4], q[2] = 0, x[5], 0
    p = points(spark, [(0, i, v.tolist(), None, None) for i, v in enumerate(x)])
    for metric in ("l2", "dot", "cosine"):
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
        d = {"l2": ((q[:, None] - x) ** 2).sum(-1), "dot": -(q @ x.T), "cosine": np.where(n < 1e-12, 1.0, 1 - (q @ x.T) / np.maximum(n, 1e-300))}[metric]
        got = {}
        for r in search.batch_nearest(p, q.tolist(), 4, metric).collect():
            got.setdefault(r["query"], []).append((round(r["score"], 9), r["node_id"]))
        for i in range(7):
            assert [s for s, _ in sorted(got[i])] == sorted(np.round(d[i], 9))[:4]
    assert search.batch_nearest(p.where("false"), q.tolist(), 4).count() == 0


def test_anchor_features(spark):
    rng = np.random.default_rng(5)
    x, a = rng.standard_normal((30, 5)), rng.standard_normal((3, 5))
    p = points(spark, [(1, i * 10, v.tolist(), None, None) for i, v in enumerate(x)] + [(2, 0, x[0].tolist(), None, None)])
    f = one(features.anchor_features(p, {"low": a[0].tolist(), "high": a[1].tolist()}, a[2].tolist()))
    unit = lambda z: z / np.linalg.norm(z, axis=-1, keepdims=True)
    d = 1 - unit(x) @ unit(a).T
    assert f["n_posts"] == 30 and abs(f["low_mean"] - d[:, 0].mean()) < 1e-12 and abs(f["high_trend"] - np.polyfit(range(30), d[:, 1], 1)[0]) < 1e-12
    s = unit(x) @ unit(x).T
    assert abs(f["mean_pairwise_sim"] - s[np.triu_indices(30, 1)].mean()) < 1e-12
    assert abs(f["anchor_vel_magnitude"] - np.linalg.norm((d[16, :2] - d[14, :2]) / 20)) < 1e-12 and abs(f["dispersion_ratio"] - x[15:].std(0).mean() / x[:15].std(0).mean()) < 1e-6
    step = 1 - (unit(x)[1:] * unit(x)[:-1]).sum(1)
    assert abs(f["vel_mean"] - (step / 10).mean()) < 1e-12


def test_reference_rules(spark):
    """Figures that follow from the published rules: decision process, online severity, features, motifs."""
    e = spark.createDataFrame([(1, 0, 0, "navigate", 1.0), (1, 1, 1, "take", 1.0), (1, 2, 2, "place", 1.0), (2, 0, 0, "navigate", 0.0), (2, 1, 1, "drop", 0.0), (2, 2, 3, "place", 0.0)], "episode_id int, step int, region int, action string, reward double")
    rate = {(r["region"], r["action"]): r["success"] for r in learning.action_success(e).collect()}
    assert rate == {(0, "navigate"): 0.5, (1, "take"): 2 / 3, (1, "drop"): 1 / 3}  # the last step leads nowhere
    assert tuple(one(learning.mdp_stats(e))) == (4, 3, 4)
    assert {r["region"]: r["hint"] for r in learning.hints(e).collect()}[1] == "Action success rates: take(67%), drop(33%)"
    d = changes.Online()
    hit = [d.observe(np.full(2, v)) for v in [0.0] * 10 + [9.0]][-1]
    assert abs(hit[0] - (1 - np.exp(-np.sqrt(2) * 0.45))) < 1e-12
    p = points(spark, [(1, t, [float(v)], None, None) for t, v in ((0, 0), (10, 5), (40, 8))])
    f = one(mining.temporal_features(p))["features"]
    assert f[0] == 8 / 40 and f[1] == 8.0 and abs(f[2] - np.std([0.5, 0.1], ddof=1)) < 1e-12


def test_validation_reasons(spark):
    nan, inf = float("nan"), float("inf")
    p = points(spark, [(1, 0, v, None, None) for v in (None, [], [1.0], [nan, 1.0], [inf, 1.0], [0.0, 0.0], [1.0, 2.0], [None, 1.0])])
    ok, bad = split_valid(p, 2)
    assert [r["node_id"] for r in ok.collect()] == [6]
    assert [r["reason"] for r in bad.orderBy("node_id").collect()] == ["empty_vector", "empty_vector", "wrong_dimension", "nan", "infinite", "zero_vector", "nan"]


def test_delta_pq_store_round_trips(spark, tmp_path):
    rng = np.random.default_rng(0)
    p = points(spark, [(e, int(t), rng.standard_normal(4).tolist(), None, None) for e in (1, 2) for t in range(25)])
    back = {r["node_id"]: r["vector"] for r in storage.delta_decode(storage.delta_encode(p, 7), 7, 4).collect()}
    assert all(np.allclose(back[r["node_id"]], r["vector"]) for r in p.collect())
    book = storage.Codebook.train(p, 2, 25, 10)
    coded = book.encode(p)
    q = [0.1, 0.2, 0.3, 0.4]
    r = one(coded.select(book.decode(F.col("codes")).alias("v"), book.distance(F.col("codes"), np.array(q)).alias("d")))
    assert abs(((np.array(r["v"]) - q) ** 2).sum() - r["d"]) < 1e-9
    storage.write_points(p.drop("metadata"), str(tmp_path / "s"), 10)
    assert storage.read_range(spark, str(tmp_path / "s"), 5, 12, 10).count() == 16


def test_lsh_finds_itself(spark):
    rng = np.random.default_rng(2)
    v = [rng.standard_normal(8).tolist() for _ in range(50)]
    p = points(spark, [(1, 0, x, None, None) for x in v])
    cfg = lsh.LshConfig(tables=4, bits=4)
    assert one(lsh.search(p, lsh.build(p, 8, cfg), v[7], 0, 1, cfg))["node_id"] == 7


def test_files_and_embedding(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"post_id": "1", "text": "hi"}), "broken"]))
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "s.xml").write_text("<I><WRITING><TITLE>t</TITLE><TEXT>one</TEXT></WRITING><WRITING><TEXT>two</TEXT></WRITING></I>")
    assert sorted(r["TEXT"] for r in files.read_xml(spark, str(tmp_path / "s.xml")).collect()) == ["one", "two"]
    with tarfile.open(tmp_path / "x.tgz", "w:gz") as t:
        t.add(tmp_path / "a.jsonl", "in/a.jsonl")
    assert one(files.read_tar(spark, str(tmp_path / "x.tgz")))["name"] == "in/a.jsonl"
    df = spark.createDataFrame([("abc",), (None,), ("",)], "s string")
    got = [r["embedding"] for r in embed.embed(df, "s", 4).collect()]
    assert got[1] is None and abs(sum(x * x for x in got[0]) - 1) < 1e-9 and got[2] is None  # an empty text is refused
    files.save(df, str(tmp_path / "snap"), 3)
    assert files.load(spark, str(tmp_path / "snap"), 3).count() == 3
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "snap"), 2)


def test_plan_pushes_filters(spark, sf, capsys):
    from vectide.session import table

    table(spark, sf, "ingestpoint").where(TemporalFilter.between(5, 6).column()).select("node_id").explain("formatted")
    text = capsys.readouterr().out
    assert "GreaterThanOrEqual(t,5)" in text and "ReadSchema: struct<node_id:bigint,t:bigint>" in text
    search.nearest(ingested(spark, sf), SearchSpec([0.0] * 64, when=TemporalFilter.between(5, 6))).explain("formatted")
    text = capsys.readouterr().out
    assert "GreaterThanOrEqual(t,5)" in text and "TakeOrderedAndProject" in text


def test_small_search_helpers(spark):
    p = points(spark, [(1, 0, [0.0, 0.0], 0.1, None), (1, 1, [0.0, 0.1], None, None), (1, 2, [3.0, 0.0], None, None)])
    near = search.nearest(p, SearchSpec([0.0, 0.0], 3))
    assert [r["node_id"] for r in search.diverse(near, 5).collect()] == [0, 2] or [r["node_id"] for r in search.diverse(near, 5).collect()] == [0]
    up = spark.createDataFrame([(0, 0.9, 1), (0, 0.5, 2), (2, None, 1), (None, 1.0, 1)], "node_id long, reward double, version int")
    assert {r["node_id"]: r["reward"] for r in search.set_rewards(p, up).collect()} == {0: 0.5, 1: None, 2: None}
    a = spark.createDataFrame([([1, 2], [3, 2, 4], [2])], "p array<int>, b array<int>, x array<int>")
    assert one(a.select(search.active_neighbours(F.col("p"), F.col("b"), F.col("x"), 2).alias("n")))["n"] == [1, 3]
    assert search.nearest_over([p, p], SearchSpec([0.0, 0.0], 9)).count() == 3


def test_every_hub_takes_part_in_transport(spark, monkeypatch):
    from vectide.kernels import statistics
    from vectide.plans import catalogue_mining

    n = 1100  # hubs; each stands on its own spot, its entity's points too
    p = spark.createDataFrame([(256 * (i + 1) if j == 0 else 256 * (i + 1) + j, i % 1099, j, [float(i), float(i * i % 97)], None, None) for i in range(n) for j in range(2)], POINT)
    monkeypatch.setattr(catalogue_mining, "ingested", lambda s, d: p)
    got = {r["entity_id"]: r["distance"] for r in catalogue_mining.sliced_wasserstein(spark, "").collect()}
    c, q = np.array([[float(i), float(i * i % 97)] for i in range(n)]), np.full(n, 1 / n)
    for e in (0, 1, 999, 1000, 1098):
        at = np.array([i % 1099 == e for i in range(n)], float)
        assert abs(got[e] - statistics.sliced_wasserstein(at / at.sum(), q, c, 20)) < 1e-6, e
    assert len(got) == 1099


@pytest.mark.parametrize("name", ["pq_search", "lsh_search"])
def test_recall_of_approximate_searches(name, spark, sf, monkeypatch):
    from vectide.plans import catalogue, catalogue_graph, catalogue_search

    asked = [[float(x) for x in r["vector"]] for r in catalogue_graph.table(spark, sf, "anchors").orderBy("anchor_idx").collect()]
    rows = ingested(spark, sf).select("node_id", "vector").collect()
    ids, x = np.array([r["node_id"] for r in rows]), np.array([r["vector"] for r in rows])
    found = []
    for q in asked:
        one_anchor = spark.createDataFrame([(0, q)], "anchor_idx int, vector array<double>")
        for m in (catalogue_graph, catalogue_search):
            monkeypatch.setattr(m, "table", lambda s, d, n: one_anchor)
        best = set(ids[np.lexsort((ids, ((x - q) ** 2).sum(1)))[:10]].tolist())
        found.append(len(best & {r["node_id"] for r in catalogue.QUERIES[name](spark, sf).collect()}) / 10)
    print(name, found)
    assert np.mean(found) >= 0.9


def test_nearest_hub_ties_and_memory(spark):
    # the point lies 2e-11 nearer to hub 5 than to hub 4 in square: equal to nine digits, so the lower id counts
    p = points(spark, [(1, 0, [1.0, 0.0], None, None)])
    h = spark.createDataFrame([(4, [0.0, 0.0]), (5, [1e-11, 0.0]), (3, [5.0, 5.0]), (9, [0.0, 0.0])], "hub long, hub_vector array<double>")
    assert [r["hub"] for r in regions.assign(p, h).collect()] == [4]
    assert regions.assign(p, h.where("false")).count() == 0
    # a whole batch against as many hubs as sf0.1 has ten times over: 10,000 x 24,000 distances never stand at once
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((10_000, 8)), rng.standard_normal((24_000, 8))
    y[100] = y[90] = x[7]
    tracemalloc.start()
    at, d = regions.nearest_rows(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and at[7] == 90 and d[7] == 0
    every = ((x[:200, None] - y[None]) ** 2).sum(-1)
    assert (at[:200] == every.argmin(1)).all() and np.abs(d[:200] - every.min(1)).max() < 1e-12
    # sizes that single precision can't hold
    at, d = regions.nearest_rows(np.array([[1e30], [3e30]]), np.array([[0.0], [2.9e30]]))
    assert at.tolist() == [0, 1]


def test_region_shares_meet_hubs_once(spark):
    p = points(spark, [(e, i, [float(i), float(e)], None, None) for e in range(2) for i in range(40)])
    a = regions.assign(p, regions.hubs(p, 1))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert plan(regions.region_shares(a, 10)) == 1 and plan(regions.region_trajectory(a, 10, 0.5)) == 0


def test_walks_without_shuffled_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(a), int(b), "x", float(w)) for a, b, w in zip(rng.zipf(1.3, 900) % 150, rng.zipf(1.3, 900) % 150, rng.choice([0.005, 0.1, 0.5, 1.0, 1.7, -1.0], 900))]
    rows += [(None, 3, "x", 1.0), (4, None, "x", 1.0), (4, 5, "x", None)]
    e = spark.createDataFrame(rows, "source long, target long, edge_type string, weight double")
    starts = spark.createDataFrame([(i,) for i in [*range(140), 7, None, 999]], "start long")
    got = lambda f: {(r[0], r[1]): r[2] for r in f(e, starts, None, 3).collect()}
    joined = {}
    with monkeypatch.context() as m:
        m.setattr(graph, "MOST_EDGES", 0)
        joined = {f: got(f) for f in (graph.traverse, graph.reach)}
    monkeypatch.setattr(graph, "Scratch", None)  # neither keeps pairs on disk
    monkeypatch.setattr(graph, "MOST_CELLS", 150 * 70)
    monkeypatch.setattr(graph, "HEAVY", 8)
    for f in (graph.traverse, graph.reach):
        assert got(f) == joined[f] and len(joined[f]) > 1000
    assert graph.reach(e.where("false"), starts, None, 3).count() == 0 and graph.traverse(e, starts.where("false"), None, 3).count() == 0


def test_first_largest_group(spark):
    def plain(x, epsilon):
        best: list[int] = []
        for i in range(len(x)):
            members = [i]
            for j in range(i + 1, len(x)):
                if (((x[members] - x[j]) ** 2).sum(1) <= epsilon * epsilon).all():
                    members.append(j)
            best = members if len(members) > len(best) else best
        return best

    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 64, 65, 200):
        for epsilon in (0.0, 0.3, 0.9, 5.0):
            x = rng.standard_normal((n, 4)) / 2
            x[3:4] = x[5:6] if n > 5 else x[3:4]
            assert mining.first_largest_group(x, epsilon).tolist() == plain(x, epsilon)
    # entities with equal points are a group within 0, whatever rounding does; most of 1,500 entities near each other took minutes a window
    same = rng.standard_normal((20, 64)).tolist()
    for v in same[:3]:
        p = points(spark, [(e, 0, v, None, None) for e in range(4)])
        assert [r["entities"] for r in mining.group_temporal_join(p, 0.0, 4, 1000).collect()] == [[0, 1, 2, 3]]
    x = rng.standard_normal((1_500, 64)) / 8 / np.sqrt(rng.integers(1, 9, 1_500))[:, None]
    began = time.process_time()
    assert len(mining.first_largest_group(x, 0.9)) > 500 and time.process_time() - began < 20
