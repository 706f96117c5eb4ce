"""Comments to modelling splits and a balanced, context-rich test subset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parley.operators.corpus import normalise, supported_only
from parley.operators.sampling import balanced_subset, require_target, stratified_split


def splits(comments: DataFrame, target: str, seed: int = 42) -> DataFrame:
    """All comments with a target, marked train / val / test."""
    return stratified_split(require_target(normalise(comments), target), target, seed=seed)


def test_subset(
    test: DataFrame, lookup: DataFrame, n: int = 2000, seed: int = 42, max_chars: int = 3000
) -> DataFrame:
    """The balanced test sample of sources with moderation labels.

    ``test`` is read a few times, so pass the landed test split.
    """
    return balanced_subset(supported_only(test), lookup, n=n, seed=seed, max_chars=max_chars)
