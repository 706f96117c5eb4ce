"""Binary classification metrics from four counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds 0, 0.05 .. 1 of the sweep.
THRESHOLDS = tuple(round(i * 0.05, 2) for i in range(21))
OVERALL = "All"


def _count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def binary_counts(truth: Column, predicted: Column) -> list[Column]:
    """tp, fp, fn, tn; rows where either side is not 0 or 1 count nowhere."""
    truth, predicted = truth.cast("double"), predicted.cast("double")
    return [
        _count_if((truth == 1) & (predicted == 1)).alias("tp"),
        _count_if((truth == 0) & (predicted == 1)).alias("fp"),
        _count_if((truth == 1) & (predicted == 0)).alias("fn"),
        _count_if((truth == 0) & (predicted == 0)).alias("tn"),
    ]


def _ratio(top: Column, bottom: Column, used: Column) -> Column:
    """Zero when the denominator is zero, missing when no row was usable."""
    return F.when(used > 0, F.coalesce(F.try_divide(top, bottom), F.lit(0.0)))


def metric_columns() -> dict[str, Column]:
    """Metrics over columns tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    used = tp + fp + fn + tn
    f1p, f1n = _ratio(2 * tp, 2 * tp + fp + fn, used), _ratio(2 * tn, 2 * tn + fp + fn, used)
    # A class seen neither in truth nor in prediction is left out of the mean.
    has_p, has_n = (tp + fp + fn > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    return {
        "precision": _ratio(tp, tp + fp, used),
        "recall": _ratio(tp, tp + fn, used),
        "f1p": f1p,
        "f1n": f1n,
        "accuracy": _ratio(tp + tn, used, used),
        "macro_f1": F.try_divide(f1p * has_p + f1n * has_n, has_p + has_n),
        "support_rows": used,
        "support_pos": tp + fn,
    }


def evaluate(
    df: DataFrame, truth: Column, predicted: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """One row of metrics per key combination, in one aggregation."""
    counts = df.groupBy(*keys).agg(*binary_counts(truth, predicted))
    return counts.select(*keys, *[c.alias(n) for n, c in metric_columns().items()])


MEASURES = ("precision", "recall", "f1p", "f1n", "accuracy")


def evaluate_by_dataset(
    df: DataFrame,
    truth: Column,
    predicted: Column,
    model: str = "model",
    dataset: str = "dataset",
    exclude_before_macro: Sequence[str] = (),
) -> DataFrame:
    """Metrics per (model, dataset) and an unweighted mean per model (``All``).

    Every metric row is counted under its dataset and under ``All``, so both
    levels come from one scan.
    """
    rows = evaluate(df, truth, predicted, [model, dataset])
    if exclude_before_macro:
        rows = rows.where(~F.col(dataset).isin(*exclude_before_macro))
    both = rows.withColumn(dataset, F.explode(F.array(F.col(dataset), F.lit(OVERALL))))
    return both.groupBy(model, dataset).agg(
        *[F.avg(m).alias(m) for m in MEASURES],
        F.sum("support_rows").alias("support_rows"),
        F.sum("support_pos").alias("support_pos"),
    )


def exclude_after_macro(
    metrics: DataFrame, datasets: Sequence[str], dataset: str = "dataset"
) -> DataFrame:
    """Drop dataset rows from the report; the overall row still contains them."""
    return metrics.where(~F.col(dataset).isin(*datasets))


def response_distribution(df: DataFrame, answer: Column, model: str = "model") -> DataFrame:
    """Valid answers by model."""
    return (
        df.withColumn("response", answer)
        .dropna(subset=["response"])
        .groupBy(model, "response")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_ratio(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Negatives per positive, the weight of the positive class."""
    y = F.col(target).cast("double")
    return (
        df.groupBy(*keys)
        .agg(_count_if(y == 0).alias("negatives"), _count_if(y == 1).alias("positives"))
        .withColumn("pos_weight", F.try_divide(F.col("negatives"), F.col("positives")))
    )


def threshold_sweep(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    thresholds: Sequence[float] = THRESHOLDS,
    keys: Sequence[str] = (),
    digits: int | None = None,
) -> DataFrame:
    """Precision, recall and F1 at every threshold, from one pass.

    `digits` rounds the three (4 gives the published curves); the default keeps them whole.
    Rows are grouped by the number of thresholds their score reaches, compared
    directly; only those few groups are then spread over the thresholds.
    """
    steps = sorted(thresholds)
    # A score that is not a number reaches no threshold, though it sorts above all.
    value = F.nanvl(F.col(score).cast("double"), F.lit(float("-inf")))
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in steps]), lambda t: t <= value))
    positive = F.col(label).cast("double") == 1
    groups = df.groupBy(*keys, reached.alias("_reached")).agg(
        F.count(F.lit(1)).alias("_rows"), _count_if(positive).alias("_pos")
    )
    points = F.array(
        *[
            F.struct(F.lit(i + 1).alias("_step"), F.lit(float(t)).alias("threshold"))
            for i, t in enumerate(steps)
        ]
    )
    hit = F.col("_reached") >= F.col("_step")
    counts = (
        groups.select("*", F.inline(points))
        .groupBy(*keys, "threshold")
        .agg(
            F.sum(F.when(hit, F.col("_rows")).otherwise(0)).alias("predicted"),
            F.sum(F.when(hit, F.col("_pos")).otherwise(0)).alias("tp"),
            F.sum("_pos").alias("_all_pos"),
        )
    )

    def share(part: Column, whole: Column) -> Column:
        value = F.coalesce(F.try_divide(part, whole), F.lit(0.0))
        return value if digits is None else F.round(value, digits)

    tp, predicted, positives = F.col("tp"), F.col("predicted"), F.col("_all_pos")
    return counts.select(
        *keys,
        "threshold",
        share(tp, predicted).alias("precision"),
        share(tp, positives).alias("recall"),
        share(2 * tp, predicted + positives).alias("f1"),
        "predicted",
        "tp",
    )


def reshape_run_metrics(
    df: DataFrame,
    key: str = "key",
    value: str = "value",
    metrics: Sequence[str] = ("loss", "accuracy", "f1"),
) -> DataFrame:
    """Keys eval_<dataset>_<metric> to one row per dataset; eval_<metric> is ALL.

    Dataset names may hold underscores: the metric is the part after the last.
    """
    k = F.col(key)
    parsed = df.where(k.startswith("eval_")).select(
        F.when(
            k.rlike("^eval_.*_[^_]+$"), F.regexp_extract(k, "^eval_(.*)_[^_]+$", 1)
        ).otherwise("ALL").alias("dataset"),
        F.regexp_extract(k, "([^_]+)$", 1).alias("_metric"),
        F.col(value).alias("_value"),
    )
    return (
        parsed.where(F.col("_metric").isin(*metrics))
        .groupBy("dataset")
        .agg(*[F.max(F.when(F.col("_metric") == m, F.col("_value"))).alias(m) for m in metrics])
    )


def collapse_flags(
    metrics: DataFrame, floor: float = 0.15, model: str = "model", dataset: str = "dataset"
) -> DataFrame:
    """Flag models that answer almost one class only, and name the best others.

    Adds one row per dataset with the mean over models (``All``). The window is
    over finished metric rows: one per model and dataset.
    """
    per_dataset = metrics.groupBy(dataset)
    collapsed = F.least("f1p", "f1n") < floor
    flagged = metrics.withColumn("collapsed", collapsed)

    def best(score: str, out: str) -> DataFrame:
        # Ties go to the first model by name.
        order = F.when(~F.col("collapsed"), F.struct(-F.round(score, 9), F.col(model)))
        return F.min_by(model, order).alias(out)

    best_rows = flagged.groupBy(dataset).agg(
        best("f1p", "best_f1p_model"), best("f1n", "best_f1n_model")
    )
    mean_rows = per_dataset.agg(F.avg("f1p").alias("f1p"), F.avg("f1n").alias("f1n")).select(
        F.lit(OVERALL).alias(model), dataset, "f1p", "f1n",
        F.lit(None).cast("boolean").alias("collapsed"),
    )
    rows = flagged.select(model, dataset, "f1p", "f1n", "collapsed").unionByName(mean_rows)
    return rows.join(best_rows, dataset)
