"""Raw post files: JSON lines, XML of one subject a file, and tar archives of either."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POST = "post_id string, user_id string, date string, text string"


def read_jsonl(spark: SparkSession, path: str, schema: str = POST) -> DataFrame:
    """One row per line; broken lines give nulls, not failures."""
    return spark.read.schema(schema).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str = "WRITING", schema: str = "TITLE string, DATE string, TEXT string") -> DataFrame:
    """One row per element, with the file it came from."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).withColumn("file", F.col("_metadata.file_path"))


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, content of each regular file in (compressed) tar archives; one archive is one task's work."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"]):
                with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                    for m in tar:
                        if m.isfile() and (f := tar.extractfile(m)):
                            yield pd.DataFrame({"archive": [p], "name": [m.name], "content": [f.read().decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, name string, content string")


def save(df: DataFrame, path: str, version: int = 1) -> None:
    """A snapshot with its format version; load refuses a newer one."""
    df.withColumn("format_version", F.lit(version)).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    df = spark.read.parquet(path)
    newest = df.agg(F.max("format_version")).first()[0]
    if newest is not None and newest > version:
        raise ValueError(f"snapshot of format {newest}, this reads up to {version}")
    return df.drop("format_version")
