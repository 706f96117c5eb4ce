"""Session defaults and the shared work folder."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning covers three things the operators count on: small
# join sides found at run time, skewed join partitions, and too many reducers.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture for every column expression makes building plans slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(
    cores: int = 8, app: str = "parley", memory: str = "8g", **conf: str
) -> SparkSession:
    """A local session for tests and benches; clusters bring their own.

    In local mode the driver's heap is all the memory there is.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder of the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_root()
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


@functools.cache
def _local_root() -> str:
    """One temporary folder for all local work of this process."""
    return tempfile.mkdtemp(prefix="parley-")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder once and read it back, so its plan is never run again."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def pinned(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Hold settings of the session while jobs run, and put them back."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a small bounded result out once, so later uses do not redo its plan."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
