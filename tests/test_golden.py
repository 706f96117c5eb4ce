"""Published figures: the operators must reproduce their arithmetic."""

import pytest
from pyspark.sql import functions as F

from parley.operators import metrics as M

# Detection metrics of one model per dataset, then its mean row.
DETECTION = [
    ("ceri", 0.6410256410256411, 0.9493670886075949, 0.7653061224489796, 0.9029535864978903, 0.8626865671641791, 335),
    ("fora", 0.5714285714285714, 0.8296296296296296, 0.676737160120846, 0.7528868360277137, 0.7198952879581152, 382),
    ("iq2", 0.41784037558685444, 0.7739130434782608, 0.5426829268292683, 0.6428571428571429, 0.5989304812834224, 374),
    ("umod", 0.0, 0.0, 0.0, 0.9927710843373494, 0.9856459330143541, 209),
    ("whow", 0.4759825327510917, 0.9008264462809917, 0.6228571428571429, 0.6507936507936508, 0.6373626373626373, 364),
    ("wikitactics", 0.4097560975609756, 0.6412213740458015, 0.5, 0.5, 0.5, 336),
]
DETECTION_ALL = (0.4193388697255224, 0.6824929303403797, 0.5179305587093728, 0.7403770500856245, 0.7174201511304513, 2000)


def counts(precision, recall, accuracy, support):
    """The only whole counts tp, fp, fn, tn behind a published row."""
    for positives in range(support + 1):
        tp = recall * positives
        if abs(tp - round(tp)) > 1e-6:
            continue
        tp = round(tp)
        predicted = round(tp / precision) if precision else None
        right = round(accuracy * support)
        options = [predicted] if predicted is not None else range(support + 1)
        for p in options:
            fp, fn = p - tp, positives - tp
            tn = right - tp
            if fp >= 0 and fn >= 0 and tn >= 0 and tp + fp + fn + tn == support:
                yield tp, fp, fn, tn


def test_rows_and_mean_row_are_reproduced(spark):
    rows = []
    for name, precision, recall, f1p, f1n, accuracy, support in DETECTION:
        tp, fp, fn, tn = next(
            c for c in counts(precision, recall, accuracy, support)
            if abs(2 * c[3] / (2 * c[3] + c[1] + c[2]) - f1n) < 1e-9
        )
        cells = [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn + [(0, 0)] * tn
        rows += [("llama70b", name, y, p) for y, p in cells]
    table = spark.createDataFrame(rows, "model string, dataset string, y int, p int")
    got = {r["dataset"]: r for r in M.evaluate_by_dataset(table, F.col("y"), F.col("p")).collect()}
    for name, *values in [*DETECTION, ("All", *DETECTION_ALL)]:
        row = got[name]
        assert [row[m] for m in M.MEASURES] + [row["support_rows"]] == pytest.approx(values)


def test_exclusion_after_the_mean_keeps_it(spark):
    table = spark.createDataFrame(
        [("m", "umod", 1, 0), ("m", "ceri", 1, 1)], "model string, dataset string, y int, p int"
    )
    rows = M.evaluate_by_dataset(table, F.col("y"), F.col("p"))
    after = {r["dataset"]: r["recall"] for r in M.exclude_after_macro(rows, ["umod"]).collect()}
    assert after == {"ceri": 1.0, "All": 0.5}
    first = M.evaluate_by_dataset(table, F.col("y"), F.col("p"), exclude_before_macro=["umod"])
    assert {r["dataset"]: r["recall"] for r in first.collect()} == {"ceri": 1.0, "All": 1.0}


def test_collapse_flags_of_published_means(spark):
    # Mean F1 of both classes in the prediction task.
    published = [
        ("qwen7b", 0.2421, 0.6858), ("llama70b", 0.1935, 0.6591), ("qwen32b", 0.1212, 0.7280),
        ("olmo7b", 0.4763, 0.0070), ("olmo32b", 0.1620, 0.7163), ("llama8b", 0.4245, 0.3884),
    ]
    table = spark.createDataFrame([(m, "d", p, n) for m, p, n in published], "model string, dataset string, f1p double, f1n double")
    got = {r["model"]: r for r in M.collapse_flags(table).collect()}
    assert {m for m, r in got.items() if r["collapsed"]} == {"qwen32b", "olmo7b"}
    assert {r["best_f1p_model"] for r in got.values()} == {"llama8b"}
    assert {r["best_f1n_model"] for r in got.values()} == {"olmo32b"}
    assert got["All"]["f1p"] == pytest.approx(sum(p for _, p, _ in published) / 6)
