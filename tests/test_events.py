"""Sessions and per-key states against brute force, with nulls, ties, repeats, hot keys, empty tables and odd columns."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vectide.operators.sessions import sessionize
from vectide.operators.skew import hot_join, key_stats

SCHEMA = "pid long, u string, ts long, v double, k string, b long, n long, root long"


def rows_of(events):
    return [(p, u, t, v, "k", 1, 2, 3) for p, u, t, v in events]


def brute_sessions(events, gap):
    seen, per = set(), {}
    for p, u, t, _ in events:
        if u is None or t is None or p in seen:
            continue
        if p is not None:
            seen.add(p)
        per.setdefault(u, []).append(t)
    out = []
    for u, ts in per.items():
        ts.sort()
        cur = [ts[0]]
        for t in ts[1:]:
            if t - cur[-1] > gap:
                out.append((u, cur[0], cur[-1], cur[-1] - cur[0], len(cur)))
                cur = []
            cur.append(t)
        out.append((u, cur[0], cur[-1], cur[-1] - cur[0], len(cur)))
    return sorted(out)


def run_sessions(spark, events, gap):
    df = spark.createDataFrame(rows_of(events), SCHEMA)
    return sorted(tuple(r) for r in sessionize(df, "u", "ts", gap, "pid").collect())


def test_sessions_exact_gap_ties_nulls(spark):
    e = [(1, "a", 0, 1.0), (2, "a", 10, 1.0), (3, "a", 21, 1.0), (4, "a", 21, 1.0), (4, "a", 21, 1.0), (5, None, 3, 1.0), (6, "a", None, 1.0), (7, "b", -5, 1.0), (8, "b", 5, 1.0), (None, "b", 5, 1.0), (None, "b", 5, 1.0)]
    assert run_sessions(spark, e, 10) == brute_sessions(e, 10) == [("a", 0, 10, 10, 2), ("a", 21, 21, 0, 2), ("b", -5, 5, 10, 4)]


def test_sessions_long_chain_and_hot_key(spark):
    rng = random.Random(3)
    e = [(i, "hot", i * 9, 0.0) for i in range(700)] + [(1000 + i, rng.choice("xyz"), rng.randrange(3000), 0.0) for i in range(300)]
    assert run_sessions(spark, e, 10) == brute_sessions(e, 10)


def test_sessions_empty_and_bad_gap(spark):
    assert run_sessions(spark, [], 10) == []
    with pytest.raises(ValueError):
        sessionize(spark.createDataFrame([], SCHEMA), "u", "ts", 0)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-60, 60))), max_size=40), st.integers(1, 15))
def test_sessions_random(spark, events, gap):
    first = {}
    e = [(p, *first.setdefault(p, (u, t)), 0.0) for p, u, t in events]  # copies agree
    assert run_sessions(spark, e, gap) == brute_sessions(e, gap)


def brute_stats(events):
    seen, per = set(), {}
    for p, u, t, v in events:
        if u is None or p in seen:
            continue
        if p is not None:
            seen.add(p)
        per.setdefault(u, []).append((t, v))
    out = {}
    for u, xs in per.items():
        ts = sorted(t for t, _ in xs if t is not None)
        vs = [v for _, v in xs if v is not None]
        out[u] = (len(xs), ts[0] if ts else None, ts[-1] if ts else None, round(sum(vs) / len(vs), 9) if vs else None, max([b - a for a, b in zip(ts, ts[1:])], default=0))
    return out


def run_stats(spark, events):
    df = spark.createDataFrame(rows_of(events), SCHEMA)
    return {r["u"]: (r["n_rows"], r["first_us"], r["last_us"], round(r["mean_value"], 9) if r["mean_value"] is not None else None, r["max_gap_us"]) for r in key_stats(df, "u", "ts", "pid", "v").collect()}


def test_stats_hot_key_across_partitions(spark):
    rng = random.Random(5)
    e = [(i, "hot" if rng.random() < 0.6 else f"u{rng.randrange(40)}", rng.choice([None, rng.randrange(10**6)]) if rng.random() < 0.2 else rng.randrange(10**6), rng.choice([None, rng.random()])) for i in range(4000)]
    e += e[:100] + [(9001, None, 1, 1.0), (9002, "lone", None, None), (None, "lone", 7, 2.0), (None, "lone", 7, 2.0)]
    assert run_stats(spark, e) == brute_stats(e)


def test_stats_equal_times_and_empty(spark):
    e = [(i, "same", 5, 1.0) for i in range(500)]
    assert run_stats(spark, e) == brute_stats(e)
    assert run_stats(spark, []) == {}


def test_hot_join(spark):
    rows = spark.createDataFrame([(i % 3 if i > 50_000 else 0, i) for i in range(60_000)], "k int, x int")
    look = rows.groupBy("k").count().selectExpr("k", "count as n", "k * 10 as y")
    out = hot_join(rows, look, "k", "n", 60_000)
    assert out.count() == 60_000 and out.where("y <> k * 10 or y is null").count() == 0
