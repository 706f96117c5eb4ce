"""Score arriving comments and append the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_files(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """New Parquet files below a path as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def append_scored(
    stream: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    partition_by: str | None = None,
) -> StreamingQuery:
    """Score everything that has arrived, append it once, and stop.

    The checkpoint and the sink's commit log make each file count exactly once,
    also after a lost executor or a restarted job.
    """
    writer = (
        score(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return writer.start()
