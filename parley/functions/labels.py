"""Final labels, label names, and score decisions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.schemas import LABELS, SHORT_LABELS


def _label(positive: Column, negative: Column) -> Column:
    both, pos, neg, none = 3, 1, 2, 0
    return (
        F.when(positive & negative, both).when(positive, pos).when(negative, neg).otherwise(none)
    ).cast("long")


def label_by_presence(positive: Column, negative: Column) -> Column:
    """Any rating other than 0 counts as chosen."""
    return _label(F.coalesce(positive != 0, F.lit(False)), F.coalesce(negative != 0, F.lit(False)))


def label_by_threshold(
    positive: Column, negative: Column, threshold: int = 3, missing: str = "no"
) -> Column:
    """Ratings from the threshold on count; an unrated item is a No.

    With ``missing="null"`` an item without any rating has no label.
    """
    label = _label(
        F.coalesce(positive >= threshold, F.lit(False)),
        F.coalesce(negative >= threshold, F.lit(False)),
    )
    if missing == "null":
        return F.when(positive.isNotNull() | negative.isNotNull(), label)
    return label


def _case(code: Column, names: dict[int, str]) -> Column:
    out = None
    for value, name in names.items():
        out = F.when(code == value, name) if out is None else out.when(code == value, name)
    return out


def label_name(code: Column) -> Column:
    return _case(code, LABELS)


def short_label_name(code: Column) -> Column:
    return _case(code, SHORT_LABELS)


def label_code(name: Column) -> Column:
    out = None
    for code, text in LABELS.items():
        out = F.when(name == text, code) if out is None else out.when(name == text, code)
    return out.cast("long")


def strip_suffixes(name: Column, suffixes: tuple[str, ...]) -> Column:
    """Column names without their technical endings."""
    for suffix in suffixes:
        name = F.regexp_replace(name, re.escape(suffix), "")
    return name


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def decide(score: Column, threshold: float = 0.5) -> Column:
    """1 from the threshold on; a score that is not a number is 0."""
    return ((score >= F.lit(threshold)) & ~F.isnan(score)).cast("long")


def decide_logit(logit: Column) -> Column:
    """The same decision before the sigmoid."""
    return decide(logit, 0.0)
