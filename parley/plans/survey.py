"""Rater judgements to agreement, shares, consistency and extreme cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from parley.operators.agreement import (
    agreement_summary,
    ordinal_alpha,
    pair_agreement,
    pair_contingency,
    rating_vectors,
)
from parley.operators.ratings import (
    align_to_panel,
    extreme_cases,
    majority,
    no_human_agrees,
    with_label,
)


def agreement(
    ratings: DataFrame, panel: Sequence[str], groups: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Agreement statistics per rater group and scale."""
    vectors = rating_vectors(ratings, panel)
    pairs = pair_agreement(pair_contingency(vectors, panel))
    return agreement_summary(pairs, ordinal_alpha(vectors, panel, groups), groups, panel)


def item_labels(
    ratings: DataFrame, humans: Sequence[str], models: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Final label of every item and rater, missing ratings as No."""
    return with_label(align_to_panel(ratings, [*humans, *models], keep=keep, humans=humans))


def disagreement_cases(
    ratings: DataFrame, humans: Sequence[str], models: Sequence[str]
) -> DataFrame:
    """Items where no human shares the label most models chose."""
    return no_human_agrees(majority(item_labels(ratings, humans, models), humans, models))


def top_disagreements(
    ratings: DataFrame, humans: Sequence[str], models: Sequence[str], k: int = 10
) -> DataFrame:
    return extreme_cases(disagreement_cases(ratings, humans, models), k)
