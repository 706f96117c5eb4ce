"""Reshaping, unions and ordered output."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def id_union(tables: Sequence[DataFrame], id_col: str = "conv_id") -> DataFrame:
    """All ids that occur in any table."""
    return union_all([t.select(id_col) for t in tables]).distinct()


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, columns matched by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(columns))


def melt(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    """Columns to rows."""
    return df.unpivot(list(ids), list(values), name, value)


def spread(
    df: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence, fill=None
) -> DataFrame:
    """Rows to columns for a known list of names, one aggregation."""
    columns = []
    for n in names:
        cell = F.max(F.when(F.col(name) == n, F.col(value)))
        columns.append((cell if fill is None else F.coalesce(cell, F.lit(fill))).alias(str(n)))
    return df.groupBy(*ids).agg(*columns)


def share_of_group(counts: DataFrame, key: str, count: str, out: str) -> DataFrame:
    """Percent of a group's total, on rows that are already counts."""
    total = F.sum(count).over(Window.partitionBy(key))
    return counts.withColumn(out, F.col(count) / total * 100)


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.orderBy(*order)


def in_category_order(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """Rows in the order of a fixed list; other values last, by name."""
    listed = F.array(*[F.lit(c) for c in categories])
    place = F.array_position(listed, F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(categories) + 1), column)


def experiment_matrix(
    df: DataFrame, models: Sequence[str], prompts: Sequence[tuple[str, str]]
) -> DataFrame:
    """Every row once per model and (task, prompt), in one table and one job.

    The runs are a literal list, so this is a row-wise explode, not a join.
    """
    runs = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(t).alias("task"), F.lit(p).alias("prompt"))
            for m in models
            for t, p in prompts
        ]
    )
    return df.select("*", F.inline(runs))
