"""Structured Streaming: ingestion with de-duplication and quarantine, window counts, stateful detectors.

Every pipeline is a function from a streaming DataFrame to a streaming DataFrame or a started query; sources
and sinks are the caller's. Stateful operators need the RocksDB state store (see state_store).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vectide.kernels.changes import Online
from vectide.kernels.patterns import extend_signature
from vectide.sources.points import rejection


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def distinct_records(stream: DataFrame, key: list[str], event_time: str, late: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed, so state stays bounded. A copy later than that comes through again."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(key)


def ingest(stream: DataFrame, dim: int, store: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Appends valid points to one Parquet folder and the others, with their reason, to another; replays of a batch are written to the same place."""
    marked = stream.withColumn("reason", rejection("vector", "t", dim))

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{store}/batch={number}")
        batch.where("reason is not null").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        batch.unpersist()

    return marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(stream: DataFrame, event_time: str, late: str, width: str, slide: str | None = None) -> DataFrame:
    """Rows and entities per tumbling (or sliding) window; rows later than the watermark are dropped."""
    w = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return stream.withWatermark(event_time, late).groupBy(w).agg(F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct("entity_id").alias("n_entities"))


def session_counts(stream: DataFrame, event_time: str, late: str, gap: str, key: str = "entity_id") -> DataFrame:
    """Rows per session of a key, closed once the watermark is a gap past its end."""
    return stream.withWatermark(event_time, late).groupBy(key, F.session_window(event_time, gap).alias("session")).agg(F.count(F.lit(1)).alias("n_rows"))


class _Detector(StatefulProcessor):
    def __init__(self, rate: float, threshold: float, wait: int):
        self.options = (rate, threshold, wait)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("detector", "mean array<double>, var array<double>, anchor array<double>, count int, since int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        d = Online(*self.options)
        if self.state.exists():
            mean, var, anchor, d.count, d.since = self.state.get()
            d.mean, d.var, d.anchor = np.array(mean, float), np.array(var, float), np.array(anchor, float)
        found = []
        for pdf in [pd.concat(list(rows)).sort_values(["t", "node_id"])]:
            for t, v in zip(pdf["t"], pdf["vector"]):
                if hit := d.observe(np.asarray(v, float)):
                    found.append((key[0], int(t), float(hit[0]), hit[1].tolist()))
        if d.mean is not None:
            self.state.update((d.mean.tolist(), d.var.tolist(), d.anchor.tolist(), d.count, d.since))
        yield pd.DataFrame(found, columns=["entity_id", "t", "severity", "drift"])

    def close(self) -> None:
        pass


def detect_changes(stream: DataFrame, rate: float = 0.05, threshold: float = 3.0, wait: int = 5) -> DataFrame:
    """entity_id, t, severity, drift: the online detector per entity; its state is three vectors and two counters, rows of a batch are taken by time."""
    return stream.select("entity_id", "t", "node_id", "vector").groupBy("entity_id").transformWithStateInPandas(_Detector(rate, threshold, wait), "entity_id long, t long, severity double, drift array<double>", "Append", "None")


def watch_drift(changes: DataFrame, entity_id: int = 0, min_severity: float = 0.0) -> DataFrame:
    """Changes of one entity (0: any) from a severity on."""
    kept = changes.where(F.col("severity") >= min_severity)
    return kept if not entity_id else kept.where(F.col("entity_id") == entity_id)


class _Signature(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("signature", "sig array<double>, last array<double>, n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        sig, last, n = None, None, 0
        if self.state.exists():
            s, p, n = self.state.get()
            sig, last = np.array(s, float), np.array(p, float)
        pdf = pd.concat(list(rows)).sort_values(["t", "node_id"])
        for v in pdf["vector"]:
            v = np.asarray(v, float)
            if last is None:
                sig = np.zeros(len(v) + len(v) ** 2)
            else:
                sig = extend_signature(sig, last, v)
            last, n = v, n + 1
        self.state.update((sig.tolist(), last.tolist(), n))
        yield pd.DataFrame({"entity_id": [key[0]], "n_points": [n], "signature": [sig.tolist()]})

    def close(self) -> None:
        pass


def running_signatures(stream: DataFrame) -> DataFrame:
    """entity_id, n_points, signature (depth 2) after each batch that has points of the entity."""
    return stream.select("entity_id", "t", "node_id", "vector").groupBy("entity_id").transformWithStateInPandas(_Signature(), "entity_id long, n_points int, signature array<double>", "Update", "None")


def compact(spark: SparkSession, store: str, target: str, bucket_us: int = 7 * 86_400_000_000) -> None:
    """Rewrites the many small files of a store as one sorted, bucketed Parquet folder."""
    from vectide.operators.storage import write_points

    write_points(spark.read.parquet(store).drop("batch"), target, bucket_us)
