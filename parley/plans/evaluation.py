"""Context text to model answers to metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.parsing import normalise_binary
from parley.operators.context import with_context
from parley.operators.metrics import (
    evaluate_by_dataset,
    exclude_after_macro,
    response_distribution,
)
from parley.operators.scoring import RuleScorer, Scorer, batch_score


def score_comments(
    comments: DataFrame,
    lookup: DataFrame,
    make_scorer: Callable[[], Scorer] = RuleScorer,
    system_prompt: str = "",
) -> DataFrame:
    """Answers for every comment seen with its context."""
    return batch_score(with_context(comments, lookup), make_scorer, system_prompt)


def answer_metrics(
    answers: DataFrame, truth: str, exclude: Sequence[str] = ()
) -> DataFrame:
    """Metrics of text answers; excluded datasets still count in the mean row."""
    rows = evaluate_by_dataset(answers, F.col(truth), normalise_binary(F.col("response")))
    return exclude_after_macro(rows, exclude) if exclude else rows


def answer_distribution(answers: DataFrame) -> DataFrame:
    return response_distribution(answers, normalise_binary(F.col("response")))
