"""Splits and samples in hash order: the same rows on every run and cluster size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.hashing import hash_order, hash_uniform
from parley.operators.context import SMALL_TARGETS, with_context
from parley.operators.ordering import PREFIX_DIGITS
from parley.operators.selection import first_in_order
from parley.session import checkpointed, landed

SEED = 42


def require_target(df: DataFrame, target: str) -> DataFrame:
    """Drop rows without the target label."""
    return df.dropna(subset=[target])


def hash_split(
    df: DataFrame, train: float = 0.6, validate: float = 0.2, seed: int = SEED,
    id_col: str = "message_id", out: str = "split",
) -> DataFrame:
    """Split by hash value alone: no shuffle, shares met in expectation."""
    u = hash_uniform(hash_order(seed, F.col(id_col)))
    split = F.when(u < train, "train").when(u < train + validate, "val").otherwise("test")
    return df.withColumn(out, split)


def stratified_split(
    df: DataFrame,
    target: str,
    train: float = 0.6,
    validate: float = 0.2,
    seed: int = SEED,
    id_col: str = "message_id",
    out: str = "split",
) -> DataFrame:
    """Split every class in exact shares: round(n * share) rows in hash order.

    Instead of ranking all rows of a class, which would put a class into one
    task, the two cut points of each class are looked up: counts per hash
    prefix find the slice a cut falls into, and only that slice is ranked.
    Rows then compare their own hash with the cuts, without a shuffle.
    """
    share = train + validate
    keyed = (
        df.where(F.col(target).isNotNull())
        .select(
            F.col(target).alias("_class"),
            hash_order(seed, F.col(id_col)).alias("_digest"),
            F.col(id_col).cast("string").alias("_id"),
        )
        .withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS))
    )
    by_class = Window.partitionBy("_class")
    upto = by_class.orderBy("_prefix")
    # One row per class and prefix: at most 16 ** PREFIX_DIGITS rows for a class.
    slices = (
        keyed.groupBy("_class", "_prefix")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_upto", F.sum("_rows").over(upto))
        .withColumn("_n", F.sum("_rows").over(by_class))
        .withColumn("_before", F.col("_upto") - F.col("_rows"))
        .withColumn("_train_cut", F.floor(F.col("_n") * F.lit(train) + F.lit(0.5)))
        .withColumn("_val_cut", F.floor(F.col("_n") * F.lit(share) + F.lit(0.5)))
        .where(_cut_inside("_train_cut") | _cut_inside("_val_cut"))
        .drop("_rows", "_n")
    )
    inside = Window.partitionBy("_class", "_prefix").orderBy("_digest", "_id")
    ranked = keyed.join(F.broadcast(slices), ["_class", "_prefix"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(inside)
    )
    point = F.concat("_digest", "_id")
    cuts = ranked.groupBy("_class").agg(
        F.coalesce(F.max(F.when(F.col("_rank") == F.col("_train_cut"), point)), F.lit("")).alias("train"),
        F.coalesce(F.max(F.when(F.col("_rank") == F.col("_val_cut"), point)), F.lit("")).alias("val"),
    )
    # At most one entry per class, so the cuts travel as one literal row.
    lookup = cuts.agg(
        F.map_from_entries(F.collect_list(F.struct("_class", F.struct("train", "val"))))
    ).scalar()
    own = F.concat(hash_order(seed, F.col(id_col)), F.col(id_col).cast("string"))
    cut = F.try_element_at(lookup, F.col(target))
    split = (
        F.when(own <= cut["train"], "train").when(own <= cut["val"], "val").otherwise("test")
    )
    return df.where(F.col(target).isNotNull()).withColumn(out, split)


def _cut_inside(cut: str) -> Column:
    return (F.col(cut) > F.col("_before")) & (F.col(cut) <= F.col("_upto"))


def balanced_ids(
    df: DataFrame, n: int, key: str = "dataset", id_col: str = "message_id", seed: int = SEED
) -> DataFrame:
    """Ids of a sample of n rows spread evenly over the key: (id, origin).

    Every key gives n // k rows, or all it has; a random top-up fills to n
    without repeating a row. The top-up comes from the first n rows overall:
    at most the quota rows are missing there, so enough others remain.
    """
    if n <= 0:
        raise ValueError("the sample size must be positive")
    groups = df.select(key).distinct().count()
    quota = n // max(groups, 1)
    keyed = landed(df.select(id_col, key, hash_order(seed, F.col(id_col)).alias("_order")), "sample-keys")
    digest = F.col("_order")
    first = first_in_order(keyed, [], digest, id_col, n).withColumn("origin", F.lit("top_up"))
    if quota == 0:
        return first.select(id_col, "origin")
    even = first_in_order(keyed, [key], digest, id_col, quota).withColumn("origin", F.lit("quota"))
    pool = landed(even.unionByName(first).groupBy(id_col, "_order").agg(F.min("origin").alias("origin")), "sample-pool")
    # Rows of a quota come before all others.
    ordered = F.concat(F.when(F.col("origin") == "quota", "0").otherwise("1"), digest)
    return first_in_order(pool, [], ordered, id_col, n).select(id_col, "origin")


def balanced_subset(
    df: DataFrame,
    lookup: DataFrame,
    n: int = 2000,
    key: str = "dataset",
    seed: int = SEED,
    hops: int = 3,
    max_chars: int = 3000,
) -> DataFrame:
    """The balanced sample with its origin and context text (``discussion``).

    The ids are written once; how many there are decides whether they are sent
    to all executors or joined by a shuffle. The rows are the same either way.
    """
    ids = checkpointed(balanced_ids(df, n, key, seed=seed))
    few = n <= SMALL_TARGETS
    sample = df.join(F.broadcast(ids) if few else ids, "message_id")
    return with_context(sample, lookup, hops, max_chars, small_targets=few)


def remainder(df: DataFrame, taken: DataFrame, id_col: str = "message_id") -> DataFrame:
    """Rows not taken yet, by id."""
    return df.join(taken.select(id_col), id_col, "left_anti")


def cap_per_key(
    df: DataFrame, key: str, cap: int = 2000, id_col: str = "message_id", seed: int = SEED
) -> DataFrame:
    """At most ``cap`` rows per key, in hash order."""
    return first_in_order(df, [key], hash_order(seed, F.col(id_col)), id_col, cap)
