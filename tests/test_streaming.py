"""Streams against the same work in batch."""

import os

import pandas as pd
import pytest

from vectide.kernels.patterns import signature
from vectide.operators import mining
from vectide.streaming import pipelines

SCHEMA = "node_id long, entity_id long, t long, vector array<double>"


@pytest.fixture
def source(spark, tmp_path):
    pipelines.state_store(spark)
    rows = [(i, e, i, [float(i > 30) * 20 + e + 0.01 * (i % 3), 1.0]) for e in (1, 2) for i in range(60)]
    for k in range(3):
        pd.DataFrame(rows[k::3], columns=["node_id", "entity_id", "t", "vector"]).sort_values("t").to_parquet(tmp_path / f"{k}.parquet")
    return spark.createDataFrame(rows, SCHEMA), spark.readStream.schema(SCHEMA).parquet(str(tmp_path)), tmp_path


def run(df, path, mode="append"):
    out = []
    df.writeStream.outputMode(mode).foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_detector_equals_batch(source):
    batch, stream, path = source
    got = {(r["entity_id"], r["t"]) for r in run(pipelines.detect_changes(stream), path)}
    assert got == {(r["entity_id"], r["t"]) for r in mining.online_changes(batch).collect()} and got
    assert pipelines.watch_drift(batch.selectExpr("entity_id", "1.0 as severity"), 1, 0.5).count() == 60


def test_signature_equals_batch(source):
    batch, stream, path = source
    got = {r["entity_id"]: r["signature"] for r in run(pipelines.running_signatures(stream), path, "update")}
    for e, s in got.items():
        x = [r["vector"] for r in batch.where(f"entity_id = {e}").orderBy("t").collect()]
        assert abs(sum(s) - signature(__import__("numpy").array(x)).sum()) < 1e-6


def test_ingest_splits_valid_and_bad(spark, source):
    _, stream, path = source
    pipelines.ingest(stream.selectExpr("node_id", "t", "if(node_id = 5, array(0D, 0D), vector) as vector"), 2, str(path / "ok"), str(path / "bad"), str(path / "c")).awaitTermination()
    assert spark.read.parquet(str(path / "ok")).count() == 118
    assert {r["reason"] for r in spark.read.parquet(str(path / "bad")).collect()} == {"zero_vector"}


def test_windows_and_sessions_drop_late_rows(spark, tmp_path):
    """A row that comes a batch after the watermark has passed its window is dropped; rows within it count."""
    schema = "entity_id long, at timestamp, n long"
    minute = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    for k, rows in enumerate([[(1, minute(0), 1), (1, minute(5), 2)], [(1, minute(200), 3)], [(1, minute(205), 7)], [(1, minute(1), 4), (1, minute(201), 5)], [(1, minute(400), 6)]]):
        df = pd.DataFrame(rows, columns=["entity_id", "at", "n"])
        df["at"] = df["at"].dt.tz_localize("UTC").astype("datetime64[us, UTC]")
        df.to_parquet(tmp_path / f"{k}.parquet")
        os.utime(tmp_path / f"{k}.parquet", (1_700_000_000 + 60 * k,) * 2)  # the order in which the source takes them
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path))
    tumbling = run(pipelines.window_counts(stream(), "at", "10 minutes", "1 hour"), tmp_path / "a")
    assert sorted((r["window"]["start"].hour, r["n_rows"]) for r in tumbling) == [(0, 2), (3, 3)]  # the late row is in none; the last window is still open
    sessions = run(pipelines.session_counts(stream(), "at", "10 minutes", "30 minutes"), tmp_path / "b")
    assert sorted(r["n_rows"] for r in sessions) == [2, 3]
    once = run(pipelines.distinct_records(stream().select("n", "at"), ["n"], "at", "10 minutes"), tmp_path / "c")
    assert {r["n"] for r in once} <= {1, 2, 3, 4, 5, 6, 7}
