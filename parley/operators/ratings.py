"""Survey ratings: alignment, wide table, labels, shares, consistency, majority.

Ratings stay one long table with an ``annotator`` column. Where the analysis
needs one row per item, a single aggregation by item collects a fixed set of
columns per rater of the panel; no join per rater.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.labels import label_by_threshold
from parley.functions.parsing import malformed_flag
from parley.operators.ordering import first_k, keep_first
from parley.schemas import LABELS, SCALES

ITEM, RATER, PASS = "conv_id", "annotator", "pass_no"


def first_ratings(ratings: DataFrame, order: Sequence[str] = (PASS,)) -> DataFrame:
    """One rating per rater and item, the first in order."""
    return keep_first(ratings, [RATER, ITEM], list(order))


def repeated_rows(ratings: DataFrame, keys: Sequence[str] = (RATER, ITEM)) -> DataFrame:
    """All rows whose key occurs more than once.

    Counting combines on the map side and the join may split a hot key; a
    window count would gather every copy in one task.
    """
    counts = ratings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    repeated = counts.where(F.col("_n") > 1).select(*keys)
    return ratings.join(repeated, list(keys), "left_semi")


def _first_of(rater: str, value: Column, order: str) -> Column:
    """The rater's first value of an item, as one aggregate among many."""
    mine = F.col(RATER) == rater
    return F.min_by(value, F.when(mine, F.col(order)))


def wide_ratings(
    ratings: DataFrame,
    humans: Sequence[str],
    models: Sequence[str] = (),
    order: str = PASS,
    item_columns: Sequence[str] = (),
    rater_columns: Sequence[str] = (),
    singles: DataFrame | None = None,
) -> DataFrame:
    """One row per item with ``<rater>_<scale>`` and ``<rater>_malformed``.

    Keep-first, pivot and the malformed mean are one aggregation by item. A
    missing rating counts as not malformed. Items without any human rating are
    dropped. ``item_columns`` take the first value present in rater order;
    ``rater_columns`` (such as a rationale) are kept per human. ``singles``
    (conv_id, model, single_response) adds one column per model.
    """
    panel = [*humans, *models]
    cells = []
    for rater in panel:
        flag = F.coalesce(_first_of(rater, malformed_flag(F.col("data_malformation")), order), F.lit(0.0))
        cells.append(flag.alias(f"{rater}_malformed"))
        cells += [
            _first_of(rater, F.col(s).cast("long"), order).alias(f"{rater}_{s}") for s in SCALES
        ]
        if rater in humans:
            cells += [_first_of(rater, F.col(c), order).alias(f"{rater}_{c}") for c in rater_columns]
    for column in item_columns:
        seat = F.array_position(F.array(*[F.lit(r) for r in panel]), F.col(RATER))
        ranked = F.when(F.col(column).isNotNull() & (seat > 0), F.struct(seat, F.col(order)))
        cells.append(F.min_by(column, ranked).alias(column))
    rated = F.bool_or(F.col(RATER).isin(*humans) & _any_scale())
    wide = ratings.groupBy(ITEM).agg(*cells, rated.alias("_rated")).where("_rated").drop("_rated")
    flags = [F.col(f"{h}_malformed") for h in humans]
    wide = wide.withColumn("total_malformed", sum(flags[1:], flags[0]) / len(flags))
    if singles is not None:
        wide = wide.join(
            singles.groupBy(ITEM).agg(
                *[
                    F.max(F.when(F.col("model") == m, F.col("single_response"))).alias(
                        f"{m}_single_response"
                    )
                    for m in models
                ]
            ),
            ITEM,
            "left",
        )
    return wide


def _any_scale() -> Column:
    return F.coalesce(*SCALES).isNotNull()


def align_to_panel(
    ratings: DataFrame,
    panel: Sequence[str],
    order: str = PASS,
    keep: Sequence[str] = (),
    humans: Sequence[str] = (),
) -> DataFrame:
    """Every item once per rater of the panel, missing ratings included.

    One aggregation by item, then a row-wise explode of the panel: the grid of
    items and raters needs neither a cross join nor a join per rater. ``keep``
    names columns that depend on the item alone. With ``humans`` given, items
    without a human rating are dropped.
    """
    # Numbers only, so the aggregation keeps fixed-width buffers and hashes.
    cells = {s: F.col(s).cast("long") for s in SCALES}
    cells["_flag"] = malformed_flag(F.col("data_malformation"))
    seats = [
        _first_of(rater, cell, order).alias(f"_{i}_{name}")
        for i, rater in enumerate(panel)
        for name, cell in cells.items()
    ]
    rated = F.bool_or(F.col(RATER).isin(*humans) & _any_scale()).alias("_rated")
    items = ratings.groupBy(ITEM, *keep).agg(*seats, *([rated] if humans else []))
    if humans:
        items = items.where("_rated")
    rows = F.array(
        *[
            F.struct(
                F.lit(rater).alias(RATER), *[F.col(f"_{i}_{name}").alias(name) for name in cells]
            )
            for i, rater in enumerate(panel)
        ]
    )
    return items.select(ITEM, *keep, F.inline(rows)).select(
        ITEM,
        *keep,
        RATER,
        *SCALES,
        F.when(F.col("_flag") == 1, "yes").otherwise("no").alias("data_malformation"),
    )


def align_to_reference(items: DataFrame, answers: DataFrame, models: Sequence[str]) -> DataFrame:
    """Single-scale answers on a given id set, one row per item and model."""
    seats = [
        F.max(F.when(F.col("model") == m, F.col("single_response"))).alias(f"_m{i}")
        for i, m in enumerate(models)
    ]
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.col(f"_m{i}").alias("single_response"))
            for i, m in enumerate(models)
        ]
    )
    per_item = answers.groupBy(ITEM).agg(*seats)
    return items.select(ITEM).distinct().join(per_item, ITEM, "left").select(ITEM, F.inline(rows))


def attach_dataset(df: DataFrame, lookup: DataFrame, key: str = ITEM) -> DataFrame:
    """Add the dataset of an item; items unknown to the lookup are dropped."""
    return df.join(lookup.select(key, "dataset"), key)


def missing_dataset(df: DataFrame, lookup: DataFrame, key: str = ITEM) -> DataFrame:
    """How many items the lookup does not know."""
    return df.join(lookup.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))


def coverage(aligned: DataFrame) -> DataFrame:
    """Items fully rated per rater, on aligned ratings."""
    full = F.lit(True)
    for s in SCALES:
        full = full & F.col(s).isNotNull()
    n, covered = F.count(F.lit(1)), F.count_if(full)
    return aligned.groupBy(RATER).agg(
        n.alias("n_items"), covered.alias("n_covered"), (n - covered).alias("n_missing")
    )


def coverage_by_raters(aligned: DataFrame) -> DataFrame:
    """Items by the number of raters with a rating."""
    per_item = aligned.groupBy(ITEM).agg(F.count_if(_any_scale()).alias("n_raters"))
    counts = per_item.groupBy("n_raters").agg(F.count(F.lit(1)).alias("n_items"))
    total = F.sum("n_items").over(Window.partitionBy())
    return counts.withColumn("pct", F.col("n_items") / total * 100)


def null_report(df: DataFrame) -> DataFrame:
    """Missing values per column with at least one, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns],
    )
    return (
        counts.unpivot(["_n"], df.columns, "column_name", "n_null")
        .where(F.col("n_null") > 0)
        .select("column_name", "n_null", (F.col("n_null") / F.col("_n") * 100).alias("pct"))
    )


def pass_pairs(
    ratings: DataFrame, label: Column, order: Sequence[str] = (PASS,)
) -> DataFrame:
    """First and second label of items a rater saw twice.

    The running number stops at two, so no group is ever larger; the pair is a
    conditional aggregation instead of a self-join.
    """
    numbered = first_k(
        ratings.select(RATER, ITEM, *order, label.alias("_label")), [RATER, ITEM], list(order), 2,
        rank="_pass",
    )
    pairs = numbered.groupBy(RATER, ITEM).agg(
        F.max(F.when(F.col("_pass") == 1, F.col("_label"))).alias("pass_1"),
        F.max(F.when(F.col("_pass") == 2, F.col("_label"))).alias("pass_2"),
    )
    return pairs.dropna(subset=["pass_1", "pass_2"])


def self_consistency(pairs: DataFrame) -> DataFrame:
    """Percent of pairs with equal labels per rater."""
    equal = (F.col("pass_1") == F.col("pass_2")).cast("double")
    return pairs.groupBy(RATER).agg(
        F.count(F.lit(1)).alias("n_pairs"), (F.avg(equal) * 100).alias("pct_agreement")
    )


def certainty_histogram(
    ratings: DataFrame, exclude: Sequence[str] = (), levels: Sequence[int] = (1, 2, 3, 4, 5)
) -> DataFrame:
    """Ratings above 0 by human or model, scale and value; empty cells are 0.

    The grid is fixed, so it is one aggregation of conditional counts.
    """
    rows = ratings.where(~F.col(RATER).isin(*exclude)) if exclude else ratings
    kinds = {"human": F.col("is_human"), "model": ~F.col("is_human")}
    grid = [(k, s, v) for k in kinds for s in SCALES for v in levels]
    counts = rows.agg(
        *[F.count_if(kinds[k] & (F.col(s) == v)).alias(f"_{i}") for i, (k, s, v) in enumerate(grid)]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("kind"), F.lit(s).alias("scale"),
                F.lit(v).cast("long").alias("rating"), F.col(f"_{i}").alias("n"),
            )
            for i, (k, s, v) in enumerate(grid)
        ]
    )
    return counts.select(F.inline(cells))


def with_label(aligned: DataFrame, threshold: int = 3, missing: str = "no") -> DataFrame:
    """Add the final label of every item and rater."""
    label = label_by_threshold(
        F.col(SCALES[0]), F.col(SCALES[1]), threshold=threshold, missing=missing
    )
    return aligned.withColumn("label", label)


def label_share(labelled: DataFrame, key: str) -> DataFrame:
    """Percent of each label per rater or dataset, one column per label."""
    n = F.count("label")
    return labelled.groupBy(key).agg(
        *[
            (F.count_if(F.col("label") == code) / n * 100).alias(name.lower())
            for code, name in LABELS.items()
        ]
    )


def label_counts(labelled: DataFrame, key: str) -> DataFrame:
    """The same in rows: label, count and percent of the key's total."""
    counts = labelled.dropna(subset=["label"]).groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    return counts.withColumn("pct", F.col("n") / total * 100)


def majority(
    labelled: DataFrame, humans: Sequence[str], models: Sequence[str]
) -> DataFrame:
    """Most frequent model label per item and who shares it.

    Ties go to the smallest label. There are four labels, so the counts of
    both sides are eight conditional counts in one aggregation.
    """
    is_model, is_human = F.col(RATER).isin(*models), F.col(RATER).isin(*humans)
    codes = list(LABELS)
    counts = labelled.groupBy(ITEM).agg(
        *[F.count_if(is_model & (F.col("label") == c)).alias(f"_m{c}") for c in codes],
        *[F.count_if(is_human & (F.col("label") == c)).alias(f"_h{c}") for c in codes],
        F.count_if(is_model).alias("_models"),
    )
    top = F.greatest(*[F.col(f"_m{c}") for c in codes])
    mode = agree = None
    for c in codes:
        hit = F.col(f"_m{c}") == top
        mode = F.when(hit, c) if mode is None else mode.when(hit, c)
        mine = F.col(f"_h{c}")
        agree = F.when(hit, mine) if agree is None else agree.when(hit, mine)
    return counts.where(top > 0).select(
        ITEM,
        mode.cast("long").alias("llm_mode"),
        (top / F.col("_models")).alias("llm_agreement"),
        agree.alias("n_humans_agree"),
    )


def no_human_agrees(majorities: DataFrame) -> DataFrame:
    """Items whose model majority no human shares."""
    return majorities.where(F.col("n_humans_agree") == 0).drop("n_humans_agree")


def extreme_cases(cases: DataFrame, k: int = 10) -> DataFrame:
    """The k items the models agree on most, ranked; ties by id."""
    order = [F.desc(F.round("llm_agreement", 9)), F.asc(ITEM)]
    top = cases.orderBy(*order).limit(k)
    # The window sees k rows.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
