"""Queries of the two event problems: sessions (p2) and keys holding most records (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.operators.sessions import sessionize
from vectide.operators.skew import key_stats
from vectide.session import Scratch, micros, table

GAP_US = 1_800_000_000
HEAVY_SHARE = 0.01


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "unified")
    return sessionize(posts.select("post_id", "user_id", micros(posts, "timestamp").alias("ts_us")), "user_id", "ts_us", GAP_US, "post_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("user_id", "start_us", "end_us", F.col("n_events").alias("n_posts"))


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d)


def _stats(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "unified")
    return key_stats(posts.select("post_id", "user_id", micros(posts, "timestamp").alias("ts_us"), F.length("text").alias("text_len")), "user_id", "ts_us", "post_id", "text_len")


def p5_user_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).select("user_id", F.col("n_rows").alias("n_posts"), F.col("first_us").alias("first_post_us"), F.col("last_us").alias("last_post_us"), F.round("mean_value", 6).alias("mean_text_len"), "max_gap_us")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Users with at least 1 % of the posts that have a user; the total comes from one more partial aggregate over the users."""
    users = _stats(spark, d).select("user_id", "n_rows")
    users = Scratch(spark, "heavy").write(users)
    total = users.agg(F.sum("n_rows").alias("total"))  # one row
    return users.crossJoin(F.broadcast(total)).where(F.col("n_rows") >= HEAVY_SHARE * F.col("total")).select("user_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_sessions, p5_found, p5_user_stats)}

_P2 = """
with p as (select post_id, any_value(user_id) as user_id, any_value(epoch_us("timestamp")) as t from unified where user_id is not null and "timestamp" is not null group by post_id),
g as (select user_id, t, case when t - lag(t) over (partition by user_id order by t, post_id) <= 1800000000 then 0 else 1 end as fresh, post_id from p),
s as (select user_id, t, sum(fresh) over (partition by user_id order by t, post_id rows unbounded preceding) as no from g)
"""
_P5 = """
with p as (select post_id, any_value(user_id) as user_id, any_value(epoch_us("timestamp")) as t, any_value(length(text)) as len from unified where user_id is not null group by post_id)
"""
SQL = {
    "p2_found": _P2 + "select user_id, min(t) as start_us, max(t) as end_us, count(*) as n_posts from s group by user_id, no",
    "p2_sessions": _P2 + "select user_id, min(t) as start_us, max(t) as end_us, max(t) - min(t) as duration_us, count(*) as n_events from s group by user_id, no",
    "p5_found": _P5 + "select user_id from p group by user_id having count(*) >= 0.01 * (select count(*) from p)",
    "p5_user_stats": _P5 + """, g as (select *, t - lag(t) over (partition by user_id order by t nulls first, post_id) as gap from p)
select user_id, count(*) as n_posts, min(t) as first_post_us, max(t) as last_post_us, round(avg(len), 6) as mean_text_len, coalesce(max(gap), 0) as max_gap_us from g group by user_id""",
}
