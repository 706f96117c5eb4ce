"""Agreement between raters from counts of equal rating vectors.

Every item becomes one vector per scale: its ratings by seat, a seat per rater of
the panel, empty seats left out. Items with equal vectors are counted together
before any pair is formed. All statistics are moments of these counts, so
nothing grows with the number of items after the first aggregation. A panel may
have any size; a row of a long vector pairs two blocks of seats at a time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.parsing import zero_as_missing
from parley.operators.ratings import ITEM, PASS, RATER
from parley.schemas import SCALES

# Seats of a block; two blocks are paired in one row.
BLOCK = 64


def rating_vectors(
    ratings: DataFrame, panel: Sequence[str], scales: Sequence[str] = SCALES, order: str = PASS
) -> DataFrame:
    """(scale, vector, n_items): how many items got exactly these ratings, (seat, value) by seat.

    A seat holds the rater's first rating, so repeated rows cannot enlarge an
    item. Blank ratings (0) are missing. Raters outside the panel take no part.
    """
    seat = F.array_position(F.array(*[F.lit(r) for r in panel]), F.col(RATER)) - 1
    firsts = (
        ratings.withColumn("_seat", seat.cast("int"))
        .where("_seat >= 0")
        .groupBy(ITEM, "_seat")
        .agg(*[F.min_by(zero_as_missing(F.col(s).cast("int")), F.col(order)).alias(f"_{s}") for s in scales])
    )
    # At most one entry per rater of the panel.
    items = firsts.groupBy(ITEM).agg(
        F.sort_array(F.collect_list(F.struct("_seat", *[f"_{s}" for s in scales]))).alias("_seats")
    )

    def rated(scale: str) -> Column:
        given = F.filter("_seats", lambda e: e[f"_{scale}"].isNotNull())
        return F.transform(given, lambda e: F.struct(e["_seat"].alias("seat"), e[f"_{scale}"].alias("value")))

    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("scale"),
                rated(s).alias("vector"),
            )
            for s in scales
        ]
    )
    return (
        items.select(F.inline(rows))
        .groupBy("scale", "vector")
        .agg(F.count(F.lit(1)).alias("n_items"))
    )


def pair_contingency(vectors: DataFrame, panel: Sequence[str]) -> DataFrame:
    """Items by the two ratings of every rater pair.

    Seats are paired per distinct vector, weighted by its item count, and
    summed on the map side. A row holds the pairs of two blocks of seats.
    """
    size = F.size("vector")
    first = vectors.where(size >= 2).select(
        "*", F.explode(F.sequence(F.lit(1), size, F.lit(BLOCK))).alias("_at")
    )
    blocks = first.select(
        "scale", "n_items", "vector", F.slice("vector", F.col("_at"), F.lit(BLOCK)).alias("_a"),
        F.explode(F.sequence(F.col("_at"), size, F.lit(BLOCK))).alias("_to"),
    ).select("scale", "n_items", "_a", F.slice("vector", F.col("_to"), F.lit(BLOCK)).alias("_b"))
    both = F.flatten(
        F.transform(
            "_a",
            lambda x: F.transform(
                F.filter("_b", lambda y: y["seat"] > x["seat"]),
                lambda y: F.struct(
                    x["seat"].alias("i"), y["seat"].alias("j"),
                    x["value"].alias("value_1"), y["value"].alias("value_2"),
                ),
            ),
        )
    )
    name = F.array(*[F.lit(r) for r in panel])
    return (
        blocks.select("scale", "n_items", F.inline(both))
        .groupBy("scale", "i", "j", "value_1", "value_2")
        .agg(F.sum("n_items").alias("n"))
        .select(
            "scale",
            F.get(name, F.col("i")).alias("rater_1"),
            F.get(name, F.col("j")).alias("rater_2"),
            "value_1", "value_2", "n",
        )
    )


def _correlation(x: str, y: str) -> Column:
    """Weighted correlation of two columns; missing when one is constant."""
    n, a, b = (F.col(c).cast("double") for c in ("n", x, y))
    total, sa, sb = F.sum(n), F.sum(n * a), F.sum(n * b)
    covariance = total * F.sum(n * a * b) - sa * sb
    spread_a = total * F.sum(n * a * a) - sa * sa
    spread_b = total * F.sum(n * b * b) - sb * sb
    varied = (F.min(a) != F.max(a)) & (F.min(b) != F.max(b))
    return F.when(varied, F.try_divide(covariance, F.sqrt(spread_a) * F.sqrt(spread_b)))


def pair_agreement(contingency: DataFrame, min_items: int = 2) -> DataFrame:
    """Pearson, Spearman, quadratic weighted kappa and n of every rater pair.

    Windows run over the cells of one pair: at most one per pair of ratings.
    """
    pair = ["scale", "rater_1", "rater_2"]
    cells = Window.partitionBy(*pair)

    def rank(value: str) -> Column:
        below = F.sum("n").over(
            cells.orderBy(value).rangeBetween(Window.unboundedPreceding, -1)
        )
        own = F.sum("n").over(Window.partitionBy(*pair, value))
        total = F.sum("n").over(cells)
        # Average rank, centred so that large counts keep their precision.
        return F.coalesce(below, F.lit(0)) + (own + 1) / 2 - (total + 1) / 2

    used = F.array_sort(
        F.array_distinct(
            F.concat(F.collect_set("value_1").over(cells), F.collect_set("value_2").over(cells))
        )
    )
    ready = (
        contingency.withColumn("_rank_1", rank("value_1"))
        .withColumn("_rank_2", rank("value_2"))
        .withColumn("_used", used)
        # Kappa weighs by place among the labels the pair used.
        .withColumn("_place_1", F.array_position("_used", F.col("value_1")))
        .withColumn("_place_2", F.array_position("_used", F.col("value_2")))
    )
    n, p, q = (F.col(c).cast("double") for c in ("n", "_place_1", "_place_2"))
    observed = F.sum(n * (p - q) * (p - q))
    # Sum over all label pairs of row share * column share * distance, from moments.
    expected = F.sum(n * p * p) + F.sum(n * q * q) - 2 * F.sum(n * p) * F.sum(n * q) / F.sum(n)
    one_label = F.max(F.size("_used")) < 2
    return (
        ready.groupBy(*pair)
        .agg(
            _correlation("value_1", "value_2").alias("pearson_r"),
            _correlation("_rank_1", "_rank_2").alias("spearman_rho"),
            F.when(~one_label, F.lit(1.0) - F.try_divide(observed, expected)).alias("weighted_kappa"),
            F.sum("n").alias("n_samples"),
        )
        .where(F.col("n_samples") >= min_items)
    )


def _group_rows(groups: Mapping[str, Sequence[str]], panel: Sequence[str]) -> Column:
    """The named rater groups, their members, and by seat whether it is a member's."""
    unknown = {r for members in groups.values() for r in members} - set(panel)
    if unknown:
        raise ValueError(f"raters outside the panel: {sorted(unknown)}")
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("rater_group"),
                F.array(*[F.lit(r) for r in members]).alias("members"),
                F.array(*[F.lit(r in members) for r in panel]).alias("inside"),
            )
            for name, members in groups.items()
            if len(members) >= 2
        ]
    )


def ordinal_alpha(
    vectors: DataFrame, panel: Sequence[str], groups: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Krippendorff's alpha with ordinal distances per scale and rater group.

    Coincidences come from the value counts of each vector. The ordinal
    distance of two values is the squared difference of their mid-ranks, so
    both disagreements are moments and no pair of items is formed.
    """
    per_group = (
        vectors.select("scale", "vector", "n_items", F.inline(_group_rows(groups, panel)))
        .withColumn(
            "values",
            F.transform(
                F.filter("vector", lambda e: F.get("inside", e["seat"])), lambda e: e["value"]
            ),
        )
        .where(F.size("values") >= 2)
    )
    distinct = F.array_distinct("values")

    def count_of(v: Column) -> Column:
        return F.size(F.filter("values", lambda w: w == v))

    # At most one entry per pair of distinct ratings an item received.
    cells = F.flatten(
        F.transform(
            distinct,
            lambda c: F.transform(
                distinct,
                lambda k: F.struct(
                    c.alias("c"),
                    k.alias("k"),
                    (count_of(c) * (count_of(k) - F.when(c == k, 1).otherwise(0))).alias("pairs"),
                ),
            ),
        )
    )
    table = ["scale", "rater_group"]
    coincidence = (
        per_group.select(*table, "n_items", F.size("values").alias("m"), F.inline(cells))
        .groupBy(*table, "c", "k")
        .agg(F.sum(F.col("n_items") * F.col("pairs") / (F.col("m") - 1)).alias("o"))
    )
    cells_of = Window.partitionBy(*table)

    def mid_rank(value: str) -> Column:
        below = F.sum("o").over(
            cells_of.orderBy(value).rangeBetween(Window.unboundedPreceding, -1)
        )
        return F.coalesce(below, F.lit(0.0)) + F.sum("o").over(Window.partitionBy(*table, value)) / 2

    placed = coincidence.withColumn("a", mid_rank("c")).withColumn("b", mid_rank("k"))
    o, a, b = F.col("o"), F.col("a"), F.col("b")
    observed = F.sum(o * (a - b) * (a - b)) / 2
    expected = F.sum(o) * F.sum(o * a * a) - F.sum(o * a) * F.sum(o * a)
    alpha = F.lit(1.0) - (F.sum(o) - 1) * F.try_divide(observed, expected)
    return placed.groupBy(*table).agg(
        F.when(F.min("c") != F.max("c"), alpha).alias("krippendorff_alpha")
    )


def agreement_summary(
    pairs: DataFrame,
    alphas: DataFrame,
    groups: Mapping[str, Sequence[str]],
    panel: Sequence[str],
) -> DataFrame:
    """Mean pair statistics (missing ones skipped), alpha and mean n per group."""
    def inside(rater: str) -> Column:
        return F.array_contains("members", F.col(rater))

    means = (
        pairs.select("*", F.inline(_group_rows(groups, panel)))
        .where(inside("rater_1") & inside("rater_2"))
        .groupBy("rater_group", "scale")
        .agg(
            F.avg("pearson_r").alias("pearson_r_mean"),
            F.avg("spearman_rho").alias("spearman_rho_mean"),
            F.avg("weighted_kappa").alias("weighted_kappa_mean"),
            F.avg("n_samples").alias("avg_valid_samples"),
        )
    )
    return means.join(alphas, ["rater_group", "scale"], "full").select(
        "rater_group", "scale", "pearson_r_mean", "spearman_rho_mean", "weighted_kappa_mean",
        "krippendorff_alpha", "avg_valid_samples",
    )
