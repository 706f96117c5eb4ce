"""Helpers of the operators: landed tables and ordered slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import work_path

# Holds the difference of any two 64 bit integers.
_WIDE = "decimal(20,0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder once and read it back, so its plan is never run again."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the documents: the join sorts, and neither side is broadcast.

    Spark sizes a table by its compressed files and counts the rows of an `explode`
    as one, so a side of a GB may pass for one below the broadcast limit.
    """
    return df.hint("merge")


def hand_back() -> None:
    """Give the system what Arrow and malloc hold unused."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def handed_back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The batches; after each, memory that is held unused goes back to the system.

    A Python worker outlives its task and serves later stages too. What Arrow and
    malloc keep for reuse (several times a batch) counts against the executor until the worker ends.
    """
    for batch in batches:
        yield batch
        del batch
        hand_back()


def id_slicer(df: DataFrame, key: str, rows: int):
    """A function that maps an id to its slice: slices follow the order of the ids.

    The width comes from the number of rows and the range of the ids, so that a
    slice holds about `rows` rows of dense or evenly spread ids; ids that
    cluster give uneven slices, which are sorted on disk. A null id has slice
    -1, before all others. One narrow aggregation, one row to the driver.
    """
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n:
        return lambda column: F.lit(-1).cast("long"), 1
    slices = max(1, -(-n // rows))
    width = max(1, -(-(high - low + 1) // slices))

    def of(column: str | Column) -> Column:
        value = F.col(column) if isinstance(column, str) else column
        offset = value.cast(_WIDE) - F.lit(str(low)).cast(_WIDE)
        return F.coalesce(F.floor(offset / F.lit(str(width)).cast(_WIDE)).cast("long"), F.lit(-1).cast("long"))

    return of, slices


def id_remainder(key: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def order_buckets(rows: DataFrame, group: str, order: str, rows_per_bucket: int = 2_048) -> DataFrame:
    """Per group: its first position and the width of the buckets its positions are cut into.

    A group with many rows gets many buckets, so running totals and lookups
    inside a group never need all its rows in one task. Positions are integers;
    the result has one row per group and is landed, so a join with it is a plain
    one that adaptive execution splits where a group is large.
    """
    span = F.max(order).cast(_WIDE) - F.min(order).cast(_WIDE) + F.lit(1).cast(_WIDE)
    parts = F.ceil(F.count("*") / F.lit(rows_per_bucket))
    found = rows.groupBy(F.col(group).alias("_group")).agg(
        F.min(order).alias("_first"), F.greatest(F.ceil(span / parts).cast(_WIDE), F.lit(1).cast(_WIDE)).alias("_width")
    )
    return landed(found, "order-buckets")


def bucket_of(order: str) -> Column:
    """The bucket of a row joined with `order_buckets`; -1 for a null position."""
    offset = F.col(order).cast(_WIDE) - F.col("_first").cast(_WIDE)
    return F.coalesce(F.floor(offset / F.col("_width")).cast("long"), F.lit(-1).cast("long"))
