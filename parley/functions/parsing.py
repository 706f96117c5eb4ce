"""Turning free text answers into numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import BLANK_CLASS, BLANKS

# Answer patterns per scale. Only the first demands exactly one
# blank after its colon; that is part of the format.
DUAL_PATTERNS = {
    "positive_reinforcement": f"(?i)positive:[{BLANK_CLASS}]([0-9]+)",
    "negative_reinforcement": f"(?i)negative:[{BLANK_CLASS}]*([0-9]+)",
    "no_reinforcement": f"(?i)no reinforcement:[{BLANK_CLASS}]*([0-9]+)",
}
LENIENT_POSITIVE = f"(?i)positive:[{BLANK_CLASS}]*([0-9]+)"

# Accepted spellings of a binary answer.
YES_WORDS = ("1", "yes", "y", "true")
NO_WORDS = ("0", "no", "n", "false")


def _first_number(text: Column, pattern: str, as_type: str) -> Column:
    # No match gives an empty string, which try_cast turns into null.
    return F.regexp_extract(text, pattern, 1).try_cast(as_type)


def parse_dual(response: Column, lenient: bool = False) -> dict[str, Column]:
    """One rating per scale; an answer without the scale's line counts 0."""
    patterns = dict(DUAL_PATTERNS)
    if lenient:
        patterns["positive_reinforcement"] = LENIENT_POSITIVE
    text = F.coalesce(response, F.lit(""))
    return {
        scale: F.coalesce(_first_number(text, pattern, "long"), F.lit(0).cast("long"))
        for scale, pattern in patterns.items()
    }


def parse_single(response: Column) -> Column:
    """First run of digits as a number, missing when there is none."""
    return _first_number(response.cast("string"), "([0-9]+)", "double")


def normalise_binary(response: Column) -> Column:
    """Text answer to 0 or 1; anything else is missing."""
    word = F.lower(F.trim(response, F.lit(BLANKS)))
    return F.when(word.isin(*YES_WORDS), 1).when(word.isin(*NO_WORDS), 0).cast("long")


def normalise_binary_number(response: Column) -> Column:
    """Numeric answer: cut toward zero, only 0 and 1 are kept."""
    whole = response.cast("double").try_cast("long")
    return F.when(whole.isin(0, 1), whole)


def rating_prefix(cell: Column) -> Column:
    """Rating in front of its label, such as "4 – strong"; blank cells give 0."""
    number = F.trim(F.split(cell, " – ")[0]).try_cast("long")
    return F.coalesce(number, F.lit(0).cast("long"))


def malformed_flag(flag: Column) -> Column:
    """1.0 for yes, else 0.0; a missing flag means no."""
    yes = F.trim(F.coalesce(flag, F.lit("no")), F.lit(BLANKS)) == "yes"
    return yes.cast("double")


def zero_as_missing(rating: Column) -> Column:
    return F.nullif(rating, F.lit(0))
