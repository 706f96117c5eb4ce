"""Corpus statistics: moderator share, sizes, histograms, bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.hashing import hash_order, hash_word, poisson_draw
from parley.session import work_path

# Largest list of groups that is broadcast.
BROADCAST_GROUPS = 100_000
_TAG = "_group"


def moderator_share(
    comments: DataFrame, dataset: str = "dataset", conv: str = "conv_id"
) -> DataFrame:
    """Percent of moderator comments of every discussion."""
    return comments.groupBy(dataset, conv).agg(
        (F.avg(F.col("is_moderator").cast("double")) * 100).alias("moderator_percent")
    )


def moderator_share_macro(shares: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Mean of the discussion shares per dataset; datasets at zero are left out."""
    return (
        shares.groupBy(dataset)
        .agg(
            F.count(F.lit(1)).alias("n_discussions"),
            F.avg("moderator_percent").alias("mean_pct"),
        )
        .where(F.col("mean_pct") > 0)
    )


def landed_groups(rows: DataFrame, key: str = "dataset") -> DataFrame:
    """Rows written to the shared folder in one directory per group, with the group's tag.

    The tag is never empty, so an empty key keeps a directory of its own; rows without a key have no tag.
    """
    path = work_path(rows.sparkSession, "groups")
    tagged = rows.withColumn(_TAG, F.concat(F.lit("g"), F.col(key).cast("string")))
    tagged.write.partitionBy(_TAG).parquet(path)
    return rows.sparkSession.read.schema(tagged.schema).parquet(path)


def surviving_groups(rows: DataFrame, groups: DataFrame, key: str = "dataset") -> DataFrame:
    """Rows whose group is listed.

    Of rows landed by group only the listed directories are read, and no row
    moves: the list is broadcast if it has at most 100,000 groups, which is
    counted. More groups, and rows that are not landed, are a semi join.
    """
    if _TAG not in rows.columns:
        return rows.join(groups.select(key), key, "left_semi")
    listed = groups.select(F.concat(F.lit("g"), F.col(key).cast("string")).alias(_TAG)).distinct()
    few = listed.count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(listed) if few else listed, _TAG, "left_semi").drop(_TAG)


def moderator_counts(
    comments: DataFrame, dataset: str = "dataset", conv: str = "conv_id"
) -> DataFrame:
    """Comments and moderator comments of every discussion, and the moderator percent."""
    sizes = comments.groupBy(dataset, conv).agg(
        F.count("is_moderator").alias("n_comments"),
        F.count_if("is_moderator").alias("n_moderator"),
    )
    return sizes.withColumn(
        "moderator_percent", F.try_divide(F.col("n_moderator").cast("double"), "n_comments") * 100
    )


def bootstrap_interval(
    rows: DataFrame,
    value: str,
    ids: Sequence[str],
    key: str = "dataset",
    replicates: int = 1000,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Poisson bootstrap interval of the mean per key.

    Rows that agree in key, ids and value are counted first. The sum of n
    Poisson(1) weights is one Poisson(n) weight, so such a group draws once per
    replicate from a hash of its ids, however many rows it stands for. Groups
    are dealt by replicate: a key that holds most of them is spread like any
    other, and the sums per key need no further shuffle. Rows without a value
    take no part; a key without values has no interval.
    """
    blocks = -(-replicates // 4)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)], F.col(value).alias("_x")
    )
    own = [F.col(f"_id{i}") for i in range(len(ids))]
    counts = named.groupBy(*named.columns).agg(F.count("_x").alias("_n"))
    drawn = counts.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # One digest feeds four replicates.
    digest = hash_order(seed, F.col("_block"), *own)
    words = F.array(*[hash_word(F.col("_digest"), i) for i in range(4)])
    drawn = (
        drawn.repartition(tasks, "_block")
        .withColumn("_digest", digest)
        .select("*", F.posexplode(words).alias("_i", "_word"))
        .withColumn("_r", F.col("_block") * 4 + F.col("_i"))
        .where(F.col("_r") < replicates)
    )
    weight = poisson_draw(F.col("_n"), F.col("_word"), lambda t: hash_order(seed, F.col("_r"), *own, t))
    means = drawn.withColumn("_w", weight).groupBy("_key", "_block", "_i").agg(
        F.try_divide(F.sum(F.col("_n") * F.col("_x")), F.sum("_n")).alias("_centre"),
        F.try_divide(F.sum(F.col("_w") * F.col("_x")), F.sum("_w")).alias("_mean"),
    )
    tail = (1.0 - level) / 2
    # At most one mean per replicate and key reaches the exact percentile.
    return means.groupBy(F.col("_key").alias(key)).agg(
        F.max("_centre").alias("mean_pct"),
        F.percentile("_mean", F.lit(tail)).alias("ci_low"),
        F.percentile("_mean", F.lit(1.0 - tail)).alias("ci_high"),
    )


def discussion_sizes(
    comments: DataFrame, cap: int = 500, dataset: str = "dataset", conv: str = "conv_id"
) -> DataFrame:
    """Comments per discussion, clipped."""
    return comments.groupBy(dataset, conv).agg(
        F.least(F.count(F.lit(1)), F.lit(cap)).alias("comments_per_disc")
    )


def density_histogram(
    df: DataFrame, value: Column, bins: int, key: str = "dataset"
) -> DataFrame:
    """Density per key over shared equal-width bins of a clipped integer value.

    Rows are first counted per (key, value). The values are clipped, so what
    follows sees at most cap + 1 rows per key; the window over everything
    reads only those.
    """
    counts = df.groupBy(key, value.cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy()
    ranged = (
        counts.dropna(subset=["_v"])
        .withColumn("_min", F.min("_v").over(everything))
        .withColumn("_max", F.max("_v").over(everything))
        # A single value still gets a bin of width one around it.
        .withColumn("_lo", F.when(F.col("_min") == F.col("_max"), F.col("_min") - 0.5).otherwise(F.col("_min")))
        .withColumn("_hi", F.when(F.col("_min") == F.col("_max"), F.col("_max") + 0.5).otherwise(F.col("_max")))
        .withColumn("_width", (F.col("_hi") - F.col("_lo")) / bins)
    )
    # The last bin is closed on both sides.
    position = F.floor((F.col("_v") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo")))
    binned = (
        ranged.withColumn("bin", F.least(position, F.lit(bins - 1)).cast("long"))
        .groupBy(key, "bin", "_lo", "_width")
        .agg(F.sum("_n").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(key))
    return binned.select(
        key,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_width")).alias("bin_low"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_width")).alias("bin_high"),
        "n",
        (F.col("n") / (total * F.col("_width"))).alias("density"),
    )


def sample_counts(df: DataFrame, key: str = "dataset") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def observed(df: DataFrame, name: str, **conditions: Column) -> DataFrame:
    """Attach named counters to a plan; they fill while another action runs.

    A listener or an Observation of the same name reads them; no extra job.
    """
    counters = [
        F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()
    ]
    return df.observe(name, F.count(F.lit(1)).alias("n_rows"), *counters)


def quality_counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """The same counters as a one-row table."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()],
    )
