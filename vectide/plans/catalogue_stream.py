"""Streams over ingestpoint, run to the end of the data there is (availableNow); sinks are folders in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import vectors
from vectide.plans.base import query
from vectide.session import Scratch, table
from vectide.sources.points import rejection
from vectide.streaming import pipelines


def _stream(spark: SparkSession, d: str, files: int = 1) -> tuple[DataFrame, Scratch]:
    scratch = Scratch(spark, "stream")
    schema = table(spark, d, "ingestpoint").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/ingestpoint.parque[t]"), scratch


def _run(out: DataFrame, scratch: Scratch, mode: str = "append") -> DataFrame:
    sink, state = scratch.path(), scratch.path()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(sink if mode == "complete" else f"{sink}/batch={number}")

    out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.parquet(sink).drop("batch")


@query("select sequence, count(distinct sequence) as n from ingestpoint group by sequence")
def stream_dedup(spark, d):
    s, scratch = _stream(spark, d)
    return _run(pipelines.distinct_records(s.select("sequence", F.col("received_at").cast("timestamp").alias("received_at")), ["sequence"], "received_at", "3650 days").select("sequence", F.lit(1).cast("long").alias("n")), scratch)


@query("select epoch_us(time_bucket(interval '7 days', make_timestamp(t), timestamp '1970-01-01')) as start_us, count(*) as n_rows from ingestpoint where t is not null group by 1")
def stream_tumbling(spark, d):
    s, scratch = _stream(spark, d)
    c = pipelines.window_counts(s.withColumn("at", F.timestamp_micros("t")), "at", "3650 days", "7 days")
    return _run(c.select(F.unix_micros("window.start").alias("start_us"), "n_rows"), scratch, "complete")


@query("select epoch_us(time_bucket(interval '7 days', make_timestamp(t) - s.k * interval '3.5 days', timestamp '1970-01-01')) + s.k * 302400000000 as start_us, count(*) as n_rows from ingestpoint, range(0, 2) s(k) where t is not null group by 1")
def stream_sliding(spark, d):
    s, scratch = _stream(spark, d)
    c = pipelines.window_counts(s.withColumn("at", F.timestamp_micros("t")), "at", "3650 days", "7 days", "84 hours")
    return _run(c.select(F.unix_micros("window.start").alias("start_us"), "n_rows"), scratch, "complete")


@query("""with g as (select entity_id, t, case when t - lag(t) over (partition by entity_id order by t) < 86400000000 then 0 else 1 end as f from ingestpoint where t is not null and entity_id is not null), n as (select *, sum(f) over (partition by entity_id order by t rows unbounded preceding) as s from g)
select entity_id, min(t) as start_us, count(*) as n_rows from n group by entity_id, s""")
def stream_sessions(spark, d):
    s, scratch = _stream(spark, d)
    c = pipelines.session_counts(s.where("entity_id is not null").withColumn("at", F.timestamp_micros("t")), "at", "3650 days", "1 day")
    return _run(c.select("entity_id", F.unix_micros("session.start").alias("start_us"), "n_rows"), scratch, "complete")


@query()
def stream_changes(spark, d):
    pipelines.state_store(spark)
    s, scratch = _stream(spark, d)
    valid = s.where(rejection("vector", "t", 64).isNull()).withColumn("vector", vectors.scale(F.col("vector").cast("array<double>"), 20.0))
    found = pipelines.watch_drift(pipelines.detect_changes(valid, threshold=2.0), 0, 0.1)
    return _run(found.select("entity_id", "t", F.round("severity", 6).alias("severity")), scratch)


@query()
def stream_signatures(spark, d):
    pipelines.state_store(spark)
    s, scratch = _stream(spark, d)
    valid = s.where(rejection("vector", "t", 64).isNull()).withColumn("vector", F.col("vector").cast("array<double>"))
    out = _run(pipelines.running_signatures(valid), scratch, "update")
    return out.groupBy("entity_id").agg(F.max_by("signature", "n_points").alias("signature"), F.max("n_points").alias("n_points")).select("entity_id", "n_points", F.round(F.col("signature")[0], 6).alias("s0"))
