"""Corpus overview: sizes, words, moderation with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import word_count
from parley.operators.statistics import (
    bootstrap_interval,
    density_histogram,
    discussion_sizes,
    moderator_counts,
)


def size_histogram(comments: DataFrame, bins: int = 40, cap: int = 500) -> DataFrame:
    return density_histogram(discussion_sizes(comments, cap), F.col("comments_per_disc"), bins)


def word_histogram(comments: DataFrame, bins: int = 50, cap: int = 500) -> DataFrame:
    return density_histogram(comments, word_count(F.col("text"), cap), bins)


def moderation_intervals(comments: DataFrame, replicates: int = 1000) -> DataFrame:
    """Mean moderator share per moderated dataset with a 95 % interval."""
    intervals = bootstrap_interval(
        moderator_counts(comments), "moderator_percent", ["dataset", "n_moderator", "n_comments"], replicates=replicates
    )
    # Datasets without moderation go at the end, one row each: no join of all discussions.
    return intervals.where("mean_pct > 0")
