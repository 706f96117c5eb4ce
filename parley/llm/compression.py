"""Quality rules with compression bands: zstandard ratios of whole texts and of fixed chunks.

A ratio is the number of UTF-8 bytes of a text divided by the size of its
zstandard frame. Repetitive text compresses too well, random text not at all;
how well prose compresses grows with its length, so the limits do too. A text
is rejected if the ratio of the whole text leaves the band of its length, or if
more than a quarter of its bytes lie in chunks of 4,096 bytes whose ratios leave
the bands of theirs (the last chunk may be shorter). The bands are wide: prose of
any language and alphabet lies well inside, repeated lines and words, runs
of one character and encoded random bytes lie outside.

`measures` also gives the counts of plain rules: words, their characters, symbol
characters, lines that repeat an earlier line, and words that lie in a window of
three words found at least twice.

Defined cases: a null text counts as empty; an empty text has no words, ratio 0
and no chunk, and fails the plain rules as any text with fewer than 50 words
does. Texts are read whole; rows are independent, so ties, repeated rows,
null ids and extra columns change nothing, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word separators and symbol characters (fixed values).
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
# Rows of a batch that are Python objects at once.
SLICE_ROWS = 256
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_bytes long, ratio double, odd_share double"
)


@dataclass(frozen=True)
class Bands:
    """Limits of a ratio by length: a text below `below[i]` bytes lies within `low[i]` and `high[i]`."""

    below: tuple[int, ...] = (64, 256, 1_024, 4_096, 16_384, 65_536)
    low: tuple[float, ...] = (0.0, 0.8, 1.1, 1.35, 1.4, 1.4, 1.4)
    high: tuple[float, ...] = (4.0, 4.0, 4.0, 4.5, 5.0, 5.5, 6.0)
    chunk_bytes: int = 4_096
    max_odd_share: float = 0.25
    level: int = 3

    def holds(self, n_bytes: np.ndarray, ratios: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.below, n_bytes, side="right")
        return (ratios >= np.array(self.low)[at]) & (ratios <= np.array(self.high)[at])


BANDS = Bands()


def repeat_words(words: list) -> int:
    """Words that lie in a window of three found at least twice, each counted once."""
    n = len(words)
    if n <= WINDOW:
        return 0
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    # Numbers below n for words and for pairs, so a product of two fits 64 bits and no two windows meet.
    window = ids[: n - WINDOW + 1]
    for k in range(1, WINDOW):
        joined = window * len(numbers) + ids[k : n - WINDOW + 1 + k]
        _, window, counts = np.unique(joined, return_inverse=True, return_counts=True)
    again = counts[window] > 1
    covered = np.zeros(n, bool)
    for k in range(WINDOW):
        covered[k : n - WINDOW + 1 + k] |= again
    return int(covered.sum())


def _ratio(compressor: zstandard.ZstdCompressor, raw: bytes) -> float:
    return len(raw) / len(compressor.compress(raw))


def measure(text: str | None, compressor: zstandard.ZstdCompressor, bands: Bands = BANDS) -> tuple:
    """The values of MEASURES for one text."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.split()]
    whole, odd = 0.0, 0
    if raw:
        whole = _ratio(compressor, raw)
        size = bands.chunk_bytes
        parts = [raw[at : at + size] for at in range(0, len(raw), size)]
        lengths = np.array([len(p) for p in parts])
        ratios = np.array([_ratio(compressor, p) for p in parts]) if len(parts) > 1 else np.array([whole])
        odd = int(lengths[~bands.holds(lengths, ratios)].sum())
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(raw),
        whole,
        odd / max(1, len(raw)),
    )


def measures(text: Column, bands: Bands = BANDS) -> Column:
    """A struct of MEASURES of whole texts."""
    kinds = [pa.int64()] * 6 + [pa.float64()] * 2
    names = [part.split()[0] for part in MEASURES.split(", ")]

    @F.arrow_udf(MEASURES)
    def compression_measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressor = zstandard.ZstdCompressor(level=bands.level, write_checksum=False, write_content_size=False)
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                rows = [measure(t.as_py(), compressor, bands) for t in batch.slice(at, SLICE_ROWS)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]
                yield pa.StructArray.from_arrays(columns, names)

    return compression_measures(text)


def base_failed(found: Column) -> Column:
    """Too few words, or more than half of them in repeated windows."""
    n, again = found["n_words"], found["n_repeat_words"]
    return (n < MIN_WORDS) | (again * 100 > n * MAX_REPEAT_PERCENT)


def within_bands(found: Column, bands: Bands = BANDS) -> Column:
    """Whether the whole text's ratio and enough of its chunks lie in the bands."""
    low, high = F.lit(bands.low[-1]), F.lit(bands.high[-1])
    for below, least, most in reversed(list(zip(bands.below, bands.low, bands.high))):
        shorter = found["n_bytes"] < below
        low, high = F.when(shorter, least).otherwise(low), F.when(shorter, most).otherwise(high)
    return found["ratio"].between(low, high) & (found["odd_share"] <= bands.max_odd_share)
