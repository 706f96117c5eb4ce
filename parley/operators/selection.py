"""The first k rows of every group, and exact percentiles, without a group in one task.

Keys are hexadecimal digests, so their order is that of their digits: a round
counts rows by group and three more digits, and the prefix the k-th row falls
into is open in the next one, until it holds few rows. Rows then compare their
own digest with their group's prefix; only rows of that last prefix are put in
order. A percentile narrows a table of distinct values with counts in the same
way, between pivots. Counts are taken on the map side, so a group or a value
with a third of all rows costs no more than any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators.ordering import MANY_GROUPS, same_group, sequence
from parley.session import landed

# Digits a round looks at, digits of a digest, and rows of a prefix that need no further round.
DIGITS, WIDTH = 3, 32
BOUND = 4096
PIVOTS = 64


def _with_cuts(rows: DataFrame, cuts: DataFrame, groups: Sequence[str], few: bool) -> DataFrame:
    """Rows with `_prefix` and `_need` of their group; null where the group keeps all rows."""
    other = cuts.select(*[F.col(g).alias(f"_of_{g}") for g in groups], "_prefix", "_need")
    other = F.broadcast(other) if few else other
    return rows.join(other, same_group(rows, other, groups), "left").drop(*[f"_of_{g}" for g in groups])


def _cuts(keys: DataFrame, groups: Sequence[str], k: int) -> tuple[DataFrame, bool]:
    """Per group with more than k rows: the prefix its k-th row falls into, and how many rows are needed there.

    Also whether the groups are few.
    """
    by_group = Window.partitionBy(*groups)
    upto = by_group.orderBy("_next")
    cuts, few = None, True
    for length in range(DIGITS, WIDTH + DIGITS, DIGITS):
        if cuts is None:
            rows = keys.withColumn("_need", F.lit(k).cast("long"))
        else:
            rows = _with_cuts(keys, cuts.where(F.col("_open")), groups, few).where(F.col("_digest").startswith(F.col("_prefix")))
        # A row per group and prefix: at most 16 ** DIGITS for a group.
        counts = rows.groupBy(*groups, F.substring("_digest", 1, length).alias("_next")).agg(
            F.count("*").alias("_rows"), F.max("_need").alias("_need")
        )
        found = (
            counts.withColumn("_upto", F.sum("_rows").over(upto))
            .withColumn("_all", F.sum("_rows").over(by_group))
            .where(F.col("_all") > F.col("_need"))
            .where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_rows") < F.col("_need")))
            .select(
                *groups, F.col("_next").alias("_prefix"), (F.col("_need") - F.col("_upto") + F.col("_rows")).alias("_need"),
                ((F.col("_rows") > BOUND) & (F.col("_upto") > F.col("_need")) & F.lit(length < WIDTH)).alias("_open"),
            )
        )
        if cuts is not None:
            found = found.unionByName(cuts.where(~F.col("_open")))
        cuts = landed(found, "selection-cuts")
        few = cuts.count() <= MANY_GROUPS
        if cuts.where(F.col("_open")).isEmpty():
            return cuts, few
    return cuts, few


def first_in_order(df: DataFrame, groups: Sequence[str], digest: Column, tie: str, k: int) -> DataFrame:
    """The k rows of every group (no groups: of the table) that come first by (digest, tie); all if fewer.

    Counts run while the plan is built, once over the keys of `df` for up to 16
    million rows of a group, and once more for every further factor of 4096.
    Rows with equal digest and tie are alike: any of them are taken.
    """
    if k <= 0:
        return df.limit(0)
    names = [f"_g{i}" for i in range(len(groups))] or ["_g0"]
    own = [F.col(g).alias(n) for g, n in zip(groups, names)] or [F.lit(0).alias("_g0")]
    rows = df.select("*", *own, digest.alias("_digest"))
    cuts, few = _cuts(rows.select(*names, "_digest"), names, k)
    marked = _with_cuts(rows, cuts, names, few)
    in_prefix = F.coalesce(F.col("_digest").startswith(F.col("_prefix")), F.lit(False))
    sure = marked.where(F.col("_prefix").isNull() | (~in_prefix & (F.col("_digest") < F.col("_prefix"))))
    last = sequence(marked.where(in_prefix), [*names, "_digest", tie], "_place")
    starts = last.groupBy(*names).agg(F.min("_place").alias("_start"))
    other = starts.select(*[F.col(n).alias(f"_of_{n}") for n in names], "_start")
    other = F.broadcast(other) if few else other
    chosen = last.join(other, same_group(last, other, names)).where(F.col("_place") - F.col("_start") < F.col("_need"))
    return sure.select(*df.columns).union(chosen.select(*df.columns))


def exact_percentile(df: DataFrame, value: str, p: float, accuracy: int = 10_000, bound: int = BOUND) -> Column:
    """Exact linearly interpolated percentile of the values, as a literal; null without values.

    Values are counted once. While more than `bound` distinct values may hold the
    wanted ranks, pivots cut them into parts, and the parts with the ranks stay.
    """
    live = landed(df.select(F.col(value).cast("double").alias("v")).dropna().groupBy("v").agg(F.count("*").alias("c")), "values")
    n, distinct = live.agg(F.sum("c"), F.count("*")).first()
    if not n:
        return F.lit(None).cast("double")
    target = p * (n - 1)
    low, high = math.floor(target), min(math.ceil(target), n - 1)
    before = 0
    while distinct > bound:
        shares = [(i + 1) / (PIVOTS + 1) for i in range(PIVOTS)]
        pivots = live.agg(F.percentile_approx("v", F.array(*map(F.lit, shares)), F.lit(accuracy)).alias("p")).first()["p"]
        pivots = sorted(set(pivots))
        part = F.size(F.filter(F.array(*map(F.lit, pivots)), lambda x: x < F.col("v")))
        counts = dict(live.groupBy(part.alias("part")).agg(F.sum("c")).collect())
        first = last = None
        upto = before
        for at in sorted(counts):
            if first is None and upto + counts[at] > low:
                first, before = at, upto
            upto += counts[at]
            if upto > high:
                last = at
                break
        left = landed(live.where(part.between(first, last)), "values")
        remaining = left.count()
        if remaining == distinct:
            break
        live, distinct = left, remaining
    # At most `bound` rows.
    rows = live.orderBy("v").collect()
    upto = list(accumulate((r["c"] for r in rows), initial=before))[1:]
    at_low, at_high = (next(r["v"] for r, n in zip(rows, upto) if n > rank) for rank in (low, high))
    share = target - low
    return F.lit(at_low + (at_high - at_low) * share if share else at_low)
