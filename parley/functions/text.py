"""Text expressions. All are built-in functions, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, as a regular
# expression class body and as a literal set for trimming.
BLANK_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Web words added to any stop list.
WEB_STOP_WORDS = ("http", "www", "org", "wiki", "wikipedia", "en")

# Default stop list: the English list that ships with Spark ML. Callers pass
# their own list to reproduce figures made with another one.
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he
    him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under
    again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can
    will just don should now
    i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm
    you're he's she's it's we're they're i've we've you've they've isn't aren't
    wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
    shan't shouldn't mustn't can't couldn't cannot could here's how's let's
    ought that's there's what's when's where's who's why's would
    """.split()
)


def null_as_word(text: Column, word: str | None = "nan") -> Column:
    """Missing text becomes a word; None leaves it missing."""
    return text if word is None else F.coalesce(text, F.lit(word))


def truncate_comment(text: Column, max_chars: int = 3000) -> Column:
    """At most max_chars characters; a cut text loses its trailing blanks."""
    cut = F.rtrim(F.substring(text, 1, max_chars), F.lit(BLANKS))
    return F.when(F.char_length(text) <= max_chars, text).otherwise(cut)


def redact_prompt(
    text: Column,
    max_chars: int = 3000,
    words: Sequence[str] = ("moderator", "Moderator"),
    mask: str = "X",
) -> Column:
    """The prompt text: cut first, then every given word masked, case exact."""
    out = F.substring(null_as_word(text), 1, max_chars)
    for word in words:
        out = F.replace(out, F.lit(word), F.lit(mask))
    return out


def single_blanks(text: Column) -> Column:
    """Every blank character as a plain blank, in one pass without a pattern."""
    return F.translate(text, BLANKS, " " * len(BLANKS))


def word_count(text: Column, cap: int = 500, null_text: str | None = "nan") -> Column:
    """Blank separated words, clipped at cap."""
    words = F.array_remove(F.split(single_blanks(null_as_word(text, null_text)), " "), "")
    return F.least(F.size(words), F.lit(cap)).cast("long")


def clean_text(text: Column, glued: Sequence[tuple[str, str]] = ()) -> Column:
    """Lower case letters and single blanks only, without web addresses.

    ``glued`` lists (joined, separated) word pairs to repair first.
    """
    out = single_blanks(F.lower(F.coalesce(text, F.lit(""))))
    for joined, separated in glued:
        out = F.replace(out, F.lit(joined), F.lit(separated))
    out = F.regexp_replace(out, "(?:http|www)[^ ]+", "")
    out = F.regexp_replace(out, "[^a-z ]+", "")
    return F.trim(F.regexp_replace(out, " {2,}", " "))


# The one glued word repaired before weighting phrases.
GLUED_WORDS = (("regulationroom", "regulation room"),)


def shorten(text: Column, width: int = 28) -> Column:
    """Labels over the width end in an ellipsis and keep width - 1 characters."""
    short = F.concat(F.substring(text, 1, width - 1), F.lit("…"))
    return F.when(F.char_length(text) > width, short).otherwise(text)


def content_words(clean: Column, stop_words: Sequence[str]) -> Column:
    """Words of two letters or more that are not on the stop list."""
    stop = sorted(set(stop_words))
    return F.filter(F.split(clean, " "), lambda w: (F.char_length(w) >= 2) & ~w.isin(stop))
