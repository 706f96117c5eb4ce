"""Ordered computations that survive one key holding a third of the rows.

A window partitioned by such a key would sort that third in one task. These
operators split every key into slices that are already in order (a range of an
integer position, or a prefix of a hash), work inside the slices, and carry
only one row per slice across them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.session import landed

SLICE_ROWS = 4096
PREFIX_DIGITS = 3
# Above this k Spark no longer limits groups before the shuffle.
GROUP_LIMIT = 1000
# Groups of which a row each is sent to every executor; more are joined by a shuffle.
MANY_GROUPS = 100_000


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of every key in the given order, rather than an arbitrary one.

    Spark limits each group to its first row before the shuffle, so copies of
    one key never meet in a single task.
    """
    return first_k(df, keys, order, 1)


def first_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str | None = None
) -> DataFrame:
    """The first k rows of every key; ``rank`` keeps their position as a column.

    Up to ``GROUP_LIMIT`` Spark limits groups before the shuffle; above, the table
    is put in one order by ranges. ``selection.first_in_order`` needs neither
    for orders by a digest.
    """
    name = rank or "_rank"
    if k > GROUP_LIMIT:
        ranked = _first_by_ranges(df, keys, order, k, name)
        return ranked if rank else ranked.drop(name)
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def _sliced(df: DataFrame, position: str, width: int) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(position) / F.lit(width)).cast("long"))


def next_value(
    df: DataFrame, key: str, position: str, value: str, out: str, width: int = SLICE_ROWS
) -> DataFrame:
    """Value of the next row of the key, by an integer position unique in it.

    A slice spans ``width`` positions, so it holds at most that many rows. Only
    keys with other slices than the one from 0 on need the second step, and its
    scan is filtered on the position, which reaches the file scan. The slice
    from 0 on takes part for keys that also have positions below 0. The head of
    a key's first slice follows no row, unless that slice is above 0: then it
    follows the slice from 0 on, which did not take part.
    """
    inside = Window.partitionBy(key, "_slice").orderBy(position)
    rows = _sliced(df, position, width).withColumn("_inner", F.lead(value).over(inside))
    across = Window.partitionBy(key).orderBy("_slice")
    at = F.col(position)
    early = df.where(at < 0).select(key).distinct()
    central = df.where((at >= 0) & (at < width)).join(early, key, "left_semi")
    heads = (
        _sliced(df.where((at >= width) | (at < 0)).unionByName(central), position, width)
        .groupBy(key, "_slice")
        .agg(F.min_by(value, position).alias("_head"))
        .select(
            key,
            F.coalesce(F.lag("_slice").over(across), F.when(F.col("_slice") > 0, F.lit(0))).alias("_slice"),
            "_head",
        )
        .where(F.col("_slice").isNotNull())
    )
    return (
        rows.join(heads, [key, "_slice"], "left")
        .withColumn(out, F.coalesce("_inner", "_head"))
        .drop("_slice", "_inner", "_head")
    )


def position_in_key(
    df: DataFrame, key: str, position: str, out: str, width: int = SLICE_ROWS
) -> DataFrame:
    """1-based rank of a row in its key, by an integer position unique in it.

    Positions may have gaps. Keys that fit one slice need no offsets, so only
    longer keys are counted.
    """
    inside = Window.partitionBy(key, "_slice").orderBy(position)
    rows = _sliced(df, position, width).withColumn("_inner", F.row_number().over(inside))
    outside = (F.col(position) >= width) | (F.col(position) < 0)
    long_keys = df.where(outside).select(key).distinct()
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        _sliced(df.select(key, position).join(long_keys, key, "left_semi"), position, width)
        .groupBy(key, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(key, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    return (
        rows.join(offsets, [key, "_slice"], "left")
        .withColumn(out, (F.coalesce("_before", F.lit(0)) + F.col("_inner")).cast("long"))
        .drop("_slice", "_inner", "_before")
    )


def sequence(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """Place of every row in one order over the whole table, from 0, landed in the shared folder.

    Range partitions in order, and the rows before each: the only window goes
    over one row per partition, and nothing is gathered. Ties are in any order.
    """
    # Equal rows spread by where they come from.
    full = [*order, "_tie"]
    placed = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*full)
        .sortWithinPartitions(*full)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    rows = landed(placed.drop("_tie"), "sequence")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    # One row per partition of the table.
    found = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return found.withColumn(out, place).drop("_part", "_before", "_at")


def same_group(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    """Equal groups, nulls included; `b` names them `_of_<name>`."""
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[f"_of_{n}"]) for n in names])


def _first_by_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str) -> DataFrame:
    placed = sequence(df, [*keys, *order], "_place")
    starts = placed.groupBy(*keys).agg(F.min("_place").alias("_start"))
    other = starts.select(*[F.col(g).alias(f"_of_{g}") for g in keys], "_start")
    other = F.broadcast(other) if starts.count() <= MANY_GROUPS else other
    own = (F.col("_place") - F.col("_start") + 1).cast("int")
    ranked = placed.join(other, same_group(placed, other, keys)).withColumn(rank, own)
    return ranked.where(F.col(rank) <= k).select(*df.columns, rank)


def global_rank(
    df: DataFrame, digest: str, tie: str, out: str, major: str | None = None,
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """1-based rank over the whole table by (major, digest, tie).

    Rows are ranked inside (major, digest prefix) slices. The windows across
    slices see one row per distinct major value, and per major value one row
    per prefix (at most 16 ** digits).
    """
    majors = [major] if major else []
    sliced = df.withColumn("_slice", F.substring(digest, 1, digits))
    keys = [*majors, "_slice"]
    counts = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    preceding = (Window.unboundedPreceding, -1)
    within = Window.partitionBy(*majors).orderBy("_slice").rowsBetween(*preceding)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(within), F.lit(0)))
    if major:
        totals = counts.groupBy(major).agg(F.sum("_rows").alias("_total"))
        across = Window.orderBy(major).rowsBetween(*preceding)
        totals = totals.select(
            major, F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_start")
        )
        offsets = offsets.join(totals, major).withColumn("_before", F.col("_before") + F.col("_start"))
    offsets = offsets.select(*keys, "_before")
    inside = Window.partitionBy(*keys).orderBy(digest, tie)
    return (
        sliced.withColumn("_inner", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(out, (F.col("_before") + F.col("_inner")).cast("long"))
        .drop("_slice", "_inner", "_before")
    )
