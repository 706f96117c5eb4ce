"""Batch scoring with an injected model, and head training on fixed features."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.labels import decide, sigmoid
from parley.functions.text import redact_prompt
from parley.operators.head import Head, fit_heads
from parley.operators.sampling import stratified_split
from parley.session import work_path

Scorer = Callable[[str, pd.Series], pd.Series]

# The scorer travels to the executors as a value, so they need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class RuleScorer:
    """Offline stand-in for a language model: 1 for a text that asks or thanks."""

    def __init__(self, cues: Sequence[str] = ("?", "please", "thank", "X")):
        self.cues = tuple(cues)

    def __call__(self, system_prompt: str, texts: pd.Series) -> pd.Series:
        hit = pd.Series(False, index=texts.index)
        for cue in self.cues:
            hit |= texts.str.contains(cue, regex=False)
        return hit.map({True: "1", False: "0"})


def batch_score(
    df: DataFrame,
    make_scorer: Callable[[], Scorer] = RuleScorer,
    system_prompt: str = "",
    text: str = "discussion",
    out: str = "response",
    max_chars: int = 3000,
) -> DataFrame:
    """Add the model's answer to every row.

    The prompt text is built in the JVM and is the only column that goes
    through Python, in Arrow batches. ``make_scorer`` runs once per partition,
    so a real model loads once per task.
    """

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for prompts in batches:
            yield scorer(system_prompt, prompts)

    return df.withColumn(out, answer(redact_prompt(F.col(text), max_chars)))


def feature_rows(df: DataFrame, features: str, label: Column) -> DataFrame:
    """Features as doubles, with a numeric label."""
    return df.withColumn("features", F.col(features).cast("array<double>")).withColumn("label", label.cast("double"))


def _loss(score: Column, label: Column) -> Column:
    p = F.greatest(F.least(score, F.lit(1 - 1e-15)), F.lit(1e-15))
    y = label.cast("double")
    return F.avg(F.when(score.isNotNull(), -(y * F.log(p) + (1 - y) * F.log(1 - p))))


def log_loss(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean binary log loss of probability ``score`` against ``label``; rows without a score take no part."""
    return scored.groupBy(*keys).agg(_loss(F.col("score"), F.col("label")).alias("loss"))


def train_head(
    rows: DataFrame,
    id_col: str,
    penalties: Sequence[float] = (0.0, 0.01, 0.1),
    steps: int = 25,
    seed: int = 42,
) -> tuple[Head, DataFrame]:
    """One-logit head on fixed features, positives weighted by the class ratio.

    ``rows`` has ``features`` and ``label``. The split is stratified by label,
    so a rare class has rows everywhere, and written once, by split: a step of
    the fit reads the training files and serves all penalties. The ratio is
    taken from training rows only; the penalty with the lowest validation loss
    wins (ties: the earlier). Returns the head and the rows with their split.
    """
    path = work_path(rows.sparkSession, "split")
    split = stratified_split(rows, "label", seed=seed, id_col=id_col)
    split.write.partitionBy("split").parquet(path)
    split = rows.sparkSession.read.schema(split.schema).parquet(path)
    heads = fit_heads(split.where("split = 'train'"), penalties, steps)
    losses = [_loss(_head_score(head), F.col("label")).alias(f"loss{i}") for i, head in enumerate(heads)]
    found = split.where("split = 'val'").agg(*losses).first()
    best = min(range(len(heads)), key=lambda i: (float("inf") if found[i] is None else found[i], i))
    return heads[best], split


def _head_score(head: Head, features: str = "features") -> Column:
    terms = F.zip_with(
        F.col(features).cast("array<double>"), F.array(*[F.lit(float(w)) for w in head.weights]), lambda x, w: x * w
    )
    logit = F.aggregate(terms, F.lit(float(head.bias)), lambda total, term: total + term)
    return sigmoid(F.when(F.size(features) == len(head.weights), logit))


def linear_score(
    df: DataFrame, features: str, weights: Sequence[float], bias: float = 0.0, out: str = "score"
) -> DataFrame:
    """Score array features with an exported head: sigmoid of a dot product, in the JVM.

    Features of another length than the weights, or with a missing one, have no score.
    """
    score = _head_score(Head(list(weights), bias), features)
    return df.withColumn(out, score).withColumn("decision", decide(F.col(out)))


def head_report(model: Head, split: DataFrame) -> DataFrame:
    """Rows, positives and class weight per split, and whether the head fits better than a constant.

    Both are judged by the weighted loss of the training rows, which a converged
    head lowers at any penalty; the weighted classes are equal, so the best
    constant is one half.
    """
    positive = F.count_if(F.col("label") == 1)
    train = split.where("split = 'train'")
    weight = train.agg(F.try_divide(F.count_if(F.col("label") == 0), positive)).scalar()
    scored = score_rows(model, train.select("label", "features"))
    by_class = log_loss(scored, ["label"]).agg(F.avg("loss")).scalar()
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"), positive.alias("positives")).select(
        "split", "n", "positives", weight.alias("pos_weight"),
        (by_class < F.log(F.lit(2.0))).alias("beats_constant"),
    )


def score_rows(model: Head, rows: DataFrame) -> DataFrame:
    """Add ``score``, the probability of the positive class, and the decision."""
    return linear_score(rows, "features", model.weights, model.bias)
