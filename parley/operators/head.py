"""One-logit heads on fixed features: all penalties fitted together, one data pass a step.

Rows stay where they are. A step sends the current weights to the tasks; every
task adds up the gradients of its rows for all penalties, and Spark sums those
by place, so what moves and what the driver holds is the size of the model.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Travels to the executors as a value, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Head(NamedTuple):
    """Weights of the features and the bias of one logit."""

    weights: list[float]
    bias: float

    def save(self, spark: SparkSession, path: str) -> None:
        row = spark.createDataFrame([(self.weights, self.bias)], "weights array<double>, bias double")
        row.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Head:
        row = spark.read.schema("weights array<double>, bias double").parquet(path).first()
        return Head(list(row["weights"]), row["bias"])


def usable(features: Column, length: int) -> Column:
    """Whether features have this length and only finite numbers."""
    odd = F.exists(features, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(features) == length) & ~odd, F.lit(False))


def fit_heads(train: DataFrame, penalties: Sequence[float], steps: int = 25) -> list[Head]:
    """A head per penalty from rows with array ``features`` and ``label`` 0 or 1.

    Weighted logistic loss (a positive counts as many times as there are
    negatives to one), plus half the penalty times the squared weights of the
    standardised features; the bias is free. Minimised by a fixed number of
    accelerated gradient steps whose size follows from the second moments of
    the features, so the result does not depend on when a tolerance is met and
    any engine can replay it. ``train`` is read once a step: pass a landed table.
    Rows with features of another length than the commonest (ties: the shorter),
    missing or not finite, or without a label take no part.
    """
    sized = train.where("label is not null").groupBy(F.size("features").alias("n")).count()
    lengths = sized.where("n > 0").orderBy(F.desc("count"), "n").first()
    if lengths is None:
        raise ValueError("no row to train on")
    rows = train.where(usable(F.col("features"), lengths["n"])).where("label is not null")
    classes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not classes or set(classes) - {0.0, 1.0}:
        raise ValueError(f"labels are 0 and 1, not {sorted(classes)}")
    negatives, positives = classes.get(0.0, 0), classes.get(1.0, 0)
    ratio = negatives / positives if negatives and positives else 1.0
    total = negatives + ratio * positives
    places = rows.select(F.posexplode("features").alias("at", "x")).groupBy("at")
    spread = places.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).orderBy("at").collect()
    mean = np.array([r["mean"] for r in spread])
    scale = np.array([r["sd"] or 1.0 for r in spread])

    def inputs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, len(mean))
        y = batch.column("label").to_numpy()
        x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        return x, y, np.where(y == 1, ratio, 1.0) / total

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, _, c = inputs(batch)
        return x.T @ (c[:, None] * x)

    def slopes(at: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
        def slope(batch: pa.RecordBatch) -> np.ndarray:
            x, y, c = inputs(batch)
            odds = np.exp(-np.abs(x @ at.T))
            p = np.where(x @ at.T >= 0, 1.0, odds) / (1.0 + odds)
            return (c[:, None] * (p - y[:, None])).T @ x

        return slope

    shape = (len(penalties), len(mean) + 1)
    # No eigenvalue of the second moments exceeds the largest sum of a row.
    curvature = np.abs(_summed(rows, moments, (shape[1], shape[1]))).sum(axis=1).max() / 4
    shrink = np.outer(penalties, np.append(np.ones(len(mean)), 0.0))
    size = 1.0 / (curvature + np.array(penalties, float)[:, None])
    now = before = np.zeros(shape)
    for step in range(steps):
        ahead = now + step / (step + 3) * (now - before)
        slope = _summed(rows, slopes(ahead), shape) + shrink * ahead
        now, before = ahead - size * slope, now
    raw = now[:, :-1] / scale
    return [Head(w.tolist(), float(own[-1] - w @ mean)) for w, own in zip(raw, now)]


def _summed(
    rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]
) -> np.ndarray:
    """Sum over all rows of what ``part`` gives for a batch."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "v"])

    parts = rows.select("features", "label").mapInArrow(add_up, "at int, v double")
    out = np.zeros(shape[0] * shape[1])
    for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(shape)
