"""Session helpers: table loading, time columns, and cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, name: str) -> Column:
    """µs since the epoch of a timestamp column, read as UTC whatever the session's zone."""
    col = f"`{name}`"
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {col})")
    return F.unix_micros(F.col(col))


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); only where it is unset, as in tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.environ.get("VECTIDE_TEST_SHARED")
    if not made:
        made = tempfile.mkdtemp(prefix="vectide-shared-")
        os.environ["VECTIDE_TEST_SHARED"] = made
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def clear_scratch() -> None:
    """Deletes every scratch table of this process so far; for long sessions, once their results have been read or written."""
    for s in list(_SCRATCH):
        s.clear()
    _SCRATCH.clear()


_SCRATCH: list[Scratch] = []


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder to cut lineage: they outlive executors and every reader can reach them.

    tidy: the shuffle files of a write go as soon as its table stands, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_dir(spark).rstrip('/')}/vectide/{name}-{uuid.uuid4().hex}"
        self.step = 0
        if not _SCRATCH:
            atexit.register(clear_scratch)
        _SCRATCH.append(self)

    def path(self) -> str:
        self.step += 1
        return f"{self.root}/{self.step}"

    def write(self, df: DataFrame) -> DataFrame:
        where, before = self.path(), self.spark.conf.get(_TIDY, "false")
        self.spark.conf.set(_TIDY, "true" if self.tidy else before)
        try:
            df.write.option("compression", "zstd").parquet(where)
        finally:
            self.spark.conf.set(_TIDY, before)
        out = self.spark.read.schema(df.schema).parquet(where)
        out.scratch_path = where
        return out

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in dfs:
            self._delete(df.scratch_path)

    def clear(self) -> None:
        """Delete everything written here; done at the end of the process, as results may still read it before."""
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass
