"""Result writers and the skip-if-done guard."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ATTEMPT = "attempt string"


def land_corpus(df: DataFrame, path: str) -> None:
    """The corpus as Parquet, which later scans can split, prune and filter."""
    df.write.mode("overwrite").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """All splits in one table, one partition directory per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_csv(df: DataFrame, path: str, partition_by: str | list[str] | None = None) -> None:
    """Quotes are doubled and blanks kept. Empty text reads back as missing."""
    writer = df.write.mode("overwrite").options(
        header=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    writer.csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def committed_attempt(spark: SparkSession, path: str) -> str | None:
    """Name of the attempt that is the result at a path, or nothing while there is none."""
    try:
        row = spark.read.schema(_ATTEMPT).json(f"{path}/commit").first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return row["attempt"] if row else None


def already_written(spark: SparkSession, path: str) -> bool:
    """True when a finished output exists; attempts without a commit do not count."""
    return committed_attempt(spark, path) is not None


def read_once(spark: SparkSession, path: str) -> DataFrame:
    """The result that `write_once` left at a path."""
    attempt = committed_attempt(spark, path)
    if attempt is None:
        raise FileNotFoundError(f"no finished result at {path}")
    return spark.read.parquet(f"{path}/attempts/{attempt}")


def write_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> bool:
    """Build and write a result unless it is already there. Returns whether this call's result stands.

    The plan is not even built when a result exists. Writers that start together
    each write an attempt of their own name; the first to enter it in the log of
    a file sink, which takes a batch number only once, is the result, and the
    others empty theirs. A writer that dies leaves no result behind.
    """
    if already_written(spark, path):
        return False
    attempt = uuid.uuid4().hex
    result = build()
    result.write.parquet(f"{path}/attempts/{attempt}")
    _commit(spark, path, attempt)
    won = committed_attempt(spark, path) == attempt
    if not won:
        result.limit(0).write.mode("overwrite").parquet(f"{path}/attempts/{attempt}")
    return won


def _commit(spark: SparkSession, path: str, attempt: str) -> None:
    """Enter an attempt as the result, unless another one has been entered."""
    notes = f"{path}/notes/{attempt}"
    spark.createDataFrame([(attempt,)], _ATTEMPT).coalesce(1).write.json(notes)
    query = (
        spark.readStream.schema(_ATTEMPT).json(notes)
        .writeStream.format("json")
        .option("path", f"{path}/commit")
        .option("checkpointLocation", f"{path}/progress/{attempt}")
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    except StreamingQueryException:
        # The entry of a writer that was faster is no failure.
        if not already_written(spark, path):
            raise


def export_name(prefix: str, model: str, suffix: str):
    """File name column of a model's answers, for a partitioned export."""
    return F.concat(F.lit(prefix), F.lower(F.col(model)), F.lit(suffix))
