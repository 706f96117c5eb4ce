"""Corpus normalisation and construction rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import null_as_word
from parley.operators.ordering import position_in_key
from parley.operators.sampling import cap_per_key
from parley.operators.selection import exact_percentile
from parley.schemas import DATASETS, MERGED_SOURCES, TACTIC_POLARITY, TRAINING_GROUPS


def _lookup(value: Column, names: Mapping[str, str]) -> Column:
    """Constant mapping as an expression: no join for a fixed dimension."""
    pairs = [F.lit(part) for item in names.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), value)


def normalise(
    df: DataFrame, datasets: Sequence[str] | None = None, null_text: str | None = "nan"
) -> DataFrame:
    """Optional restriction to datasets, moderator flag as a number, text never null."""
    if datasets is not None:
        df = df.where(F.col("dataset").isin(*datasets))
    return df.withColumn("is_moderator", F.col("is_moderator").cast("double")).withColumn(
        "text", null_as_word(F.col("text"), null_text)
    )


def display_names(
    df: DataFrame,
    exclude: Sequence[str] = ("vmd",),
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Drop excluded datasets and show the others by their display name."""
    names = names or {key: name for key, name, _ in DATASETS}
    shown = F.coalesce(_lookup(F.col("dataset"), names), F.col("dataset"))
    return df.where(~F.col("dataset").isin(*exclude)).withColumn("dataset", shown)


def with_modality(df: DataFrame, modality: Mapping[str, str] | None = None) -> DataFrame:
    """Add written / spoken."""
    if modality is None:
        modality = {k: m for key, name, m in DATASETS for k in (key, name)}
    return df.withColumn("modality", _lookup(F.col("dataset"), modality))


def in_training_group(
    df: DataFrame, group: str, groups: Mapping[str, Sequence[str]] = TRAINING_GROUPS
) -> DataFrame:
    """Rows of the datasets a named training group covers."""
    return df.where(F.col("dataset").isin(*groups[group]))


def label_columns(df: DataFrame, labels: str | Sequence[str]) -> dict[str, Column]:
    """One or several label columns as numbers; unknown names raise before a job runs."""
    names = [labels] if isinstance(labels, str) else list(labels)
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise KeyError(f"label columns missing: {missing}")
    return {name: F.col(name).cast("double") for name in names}


def supported_only(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Rows whose moderation labels come from the source itself."""
    kept = df.where("moderation_supported")
    return kept.where(~F.col("dataset").isin(*exclude)) if exclude else kept


def moderator_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_moderator").cast("double") == 1)


def drop_empty(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.trim(F.col(text)) != "")


def drop_deleted(df: DataFrame, text: str = "text", marker: str = "[deleted]") -> DataFrame:
    return df.where(F.col(text) != marker)


def multi_user(
    df: DataFrame, conv: str = "conv_id", user: str = "user", at_least: int = 2
) -> DataFrame:
    """Discussions with enough distinct users.

    The distinct count first combines (discussion, user) pairs on the map side,
    so one very long discussion is no problem.
    """
    kept = df.groupBy(conv).agg(F.count_distinct(user).alias("_u")).where(F.col("_u") >= at_least)
    return df.join(kept.select(conv), conv, "left_semi")


def drop_shared(df: DataFrame, other: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Discussions that do not occur in another source."""
    return df.join(other.select(conv).distinct(), conv, "left_anti")


def language_only(df: DataFrame, language: str = "en", column: str = "lang") -> DataFrame:
    return df.where(F.col(column) == language)


def rule_moderator(
    category: Column,
    score: Column,
    agreement: Column,
    supported: Column,
    categories: Sequence[str],
    min_score: float = 0.75,
    min_agreement: float = 0.5,
) -> Column:
    """Facilitative by category, or by score with a majority; never when unsupported."""
    by_category = F.coalesce(category.isin(*categories), F.lit(False))
    by_score = F.coalesce((score >= min_score) & (agreement > min_agreement), F.lit(False))
    return supported & (by_category | by_score)


def escalated(df: DataFrame, score: str, p: float = 0.6, out: str = "escalated") -> DataFrame:
    """Discussions whose score is at or above a percentile of all scores."""
    return df.withColumn(out, F.col(score) >= exact_percentile(df, score, p))


def source_statistics(
    df: DataFrame, dataset: str = "dataset", conv: str = "conv_id"
) -> DataFrame:
    """Comments and discussions per dataset.

    Counting discussions first leaves one row per discussion, so nothing has
    to be de-duplicated per dataset.
    """
    per_conv = df.groupBy(dataset, conv).agg(F.count(F.lit(1)).alias("_c"))
    return per_conv.groupBy(dataset).agg(
        F.sum("_c").alias("n_comments"), F.count(F.lit(1)).alias("n_discussions")
    )


def chunks(
    df: DataFrame, size: int = 6, conv: str = "conv_id", position: str = "turn",
    complete_only: bool = True,
) -> DataFrame:
    """Runs of consecutive comments as survey items, texts joined in order."""
    ranked = position_in_key(df, conv, position, "_pos")
    items = (
        ranked.withColumn("chunk", F.floor((F.col("_pos") - 1) / size).cast("long"))
        .groupBy(conv, "chunk")
        # A group holds at most ``size`` comments.
        .agg(F.array_sort(F.collect_list(F.struct("_pos", position, "text"))).alias("_c"))
    )
    if complete_only:
        items = items.where(F.size("_c") == size)
    first = F.col("_c")[0][position]
    return items.select(
        conv,
        "chunk",
        first.alias("first_turn"),
        F.size("_c").cast("long").alias("n_comments"),
        F.array_join(F.transform("_c", lambda c: c["text"]), "\n").alias("discussion"),
    )


def facilitative_candidates(df: DataFrame, score: str = "score", above: float = 0.6) -> DataFrame:
    """Flagged in the source or believed by the classifier."""
    return df.where((F.col("is_moderator").cast("double") == 1) | (F.col(score) > above))


def merged_and_capped(
    df: DataFrame, merged: Mapping[str, str] | None = None, cap: int = 2000, seed: int = 42
) -> DataFrame:
    """Sources of one population merged, then at most ``cap`` comments per source."""
    source = _lookup(F.col("dataset"), merged or MERGED_SOURCES)
    return cap_per_key(
        df.withColumn("source", F.coalesce(source, F.col("dataset"))), "source", cap, seed=seed
    )


def tactic_polarity(df: DataFrame, taxonomy: str = "taxonomy", tactic: str = "tactic") -> DataFrame:
    """Add the polarity of a tactic; missing for tactics outside the taxonomy."""
    names = {f"{t}|{name}": polarity for t, name, polarity in TACTIC_POLARITY}
    key = F.concat_ws("|", taxonomy, tactic)
    words = F.when(_lookup(key, names) == "+", "positive").when(
        _lookup(key, names) == "-", "negative"
    ).when(_lookup(key, names) == "", "none")
    return df.withColumn("polarity", words)


def pseudonymise(df: DataFrame, user: str = "user", salt: str = "") -> DataFrame:
    return df.withColumn(user, F.sha2(F.concat(F.lit(salt), F.col(user)), 256))
