"""Document fingerprints: one-permutation MinHash with optimal densification, in column expressions.

Every shingle of five words is hashed once; the high bits of the hash name one
of 256 bins, the smallest hash of a bin is the bin's value. An empty bin takes
the value of the first non-empty bin in its own fixed pseudorandom sequence of
bins (optimal densification: the donor is uniform among the non-empty bins and
the same for all texts). The low four bits of each value are packed, so a
fingerprint is 16 numbers of 64 bits. Likeness is the share of equal bins,
corrected for the 1/16 of unequal values whose low bits agree by chance.

No Python runs: a text's hashes stay in one array of its row, and nothing is
exploded or shuffled for a fingerprint.

Defined cases: a null text counts as empty. A text with fewer words than a
shingle has the one shingle of all its words. A text without words has no bins:
its fingerprint is the empty string, its likeness 1 to another such text and 0
to any other. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.shared import id_slicer

SHINGLE_WORDS = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 4
PER_LONG = 64 // LOW_BITS
# Donor bins tried one by one; after that all bins are ordered by a hash.
PROBES = 24
# Word separators (fixed value): blank, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
# Slices of the order of ids. At most MAX_SLICES, so their first ids (24 bytes each) may be broadcast.
ROWS_PER_SLICE, MAX_SLICES = 2_048, 10_000

_VALUE_BITS = 64 - BIN_BITS
_NO_VALUE = (1 << _VALUE_BITS) - 1
_NIBBLES = 0x1111111111111111


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once per row."""
    return F.transform(F.array(value), use).getItem(0)


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[ \t-\r]+")
    )


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    def of(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - (size - 1), F.lit(1)))
        return F.when(F.size(hashes) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, size))))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def bin_minima(hashes: Column) -> Column:
    """The smallest value of each bin, in a fixed order of bins; null for empty bins.

    Every bin gets an entry larger than any value; after sorting, the first
    entry of each bin is its minimum or that entry.
    """
    bins = F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long"))
    ends = F.transform(bins, lambda b: F.shiftleft(b, _VALUE_BITS).bitwiseOR(F.lit(_NO_VALUE)))

    def firsts(ordered: Column) -> Column:
        def is_first(x: Column, i: Column) -> Column:
            return (i == 0) | (F.shiftright(x, _VALUE_BITS) != F.shiftright(F.get(ordered, i - 1), _VALUE_BITS))

        return F.filter(ordered, is_first)

    found = let(F.sort_array(F.concat(hashes, ends)), firsts)
    return F.transform(found, lambda x: F.nullif(x.bitwiseAND(F.lit(_NO_VALUE)), F.lit(_NO_VALUE)))


def densified(values: Column) -> Column:
    def fill(known: Column) -> Column:
        def donor(i: Column, t: int) -> Column:
            return F.get(known, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int"))

        def last_resort(i: Column) -> Column:
            def ranked(x: Column, j: Column) -> Column:
                rank = F.named_struct(F.lit("rank"), F.xxhash64(i, j, F.lit(PROBES)), F.lit("x"), x)
                return F.when(x.isNotNull(), rank)

            order = F.transform(known, ranked)
            return F.array_min(order).getField("x")

        return F.transform(
            known, lambda x, i: F.coalesce(x, *[donor(i, t) for t in range(PROBES)], last_resort(i))
        )

    return let(values, fill)


def packed(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as 16 numbers of 16 low parts; null for a text without words."""

    def pack(values: Column) -> Column:
        groups = F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1))

        def number(k: Column) -> Column:
            part = F.slice(values, k * PER_LONG + 1, PER_LONG)
            low = (1 << LOW_BITS) - 1
            return F.aggregate(
                part, F.lit(0).cast("long"),
                lambda sofar, x: F.shiftleft(sofar, LOW_BITS).bitwiseOR(x.bitwiseAND(F.lit(low))),
            )

        return F.transform(groups, number)

    def of(hashes: Column) -> Column:
        return F.when(hashes.isNotNull(), let(densified(bin_minima(hashes)), pack))

    return let(shingle_hashes(F.coalesce(text, F.lit("")), size), of)


def hex_string(fingerprint: Column) -> Column:
    """Packed numbers as hexadecimal digits, one digit a bin."""
    digits = F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), PER_LONG, "0")))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two packed fingerprints, from 0 to 1."""

    def unequal(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        any_bit = x
        for bit in range(1, LOW_BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, bit))
        return F.bit_count(any_bit.bitwiseAND(F.lit(_NIBBLES)))

    chance = 1.0 / (1 << LOW_BITS)
    differ = sum((unequal(k) for k in range(1, BINS // PER_LONG)), unequal(0))
    share = 1.0 - differ / F.lit(float(BINS))
    estimate = F.least(F.greatest((share - chance) / (1.0 - chance), F.lit(0.0)), F.lit(1.0))
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(estimate)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, text, `packed`, and text and fingerprint of the next row in ascending order of ids.

    After the last row comes the first; null ids come first, rows that share an
    id are ordered by their text's hash. Rows move once, to the slice of their
    id; the first row of each slice also goes to the slice before, so every
    neighbour is found inside a slice and no window spans the table.
    """
    own = docs.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    ids = own.select("id")
    n = ids.count()
    slice_of, _ = id_slicer(ids, "id", max(ROWS_PER_SLICE, -(-n // MAX_SLICES)))
    around = Window.orderBy("slice")
    firsts = ids.groupBy(slice_of("id").alias("slice")).agg(F.min("id").alias("first"))
    firsts = firsts.select(
        "slice", "first",
        F.coalesce(F.lag("slice").over(around), F.max("slice").over(Window.partitionBy())).alias("before"),
    )
    rows = own.withColumn("slice", slice_of("id")).join(F.broadcast(firsts), "slice")
    here = F.struct(F.col("slice").alias("slice"), F.lit(0).alias("copy"))
    also = F.struct(F.col("before").alias("slice"), F.lit(1).alias("copy"))
    is_first = F.col("id").eqNullSafe(F.col("first"))
    placed = rows.select(
        "id", "text", packed(F.col("text")).alias("packed"),
        F.explode(F.when(is_first, F.array(here, also)).otherwise(F.array(here))).alias("at"),
    ).select("id", "text", "packed", "at.slice", "at.copy")
    order = Window.partitionBy("slice").orderBy("copy", "id", F.xxhash64("text"), "text")
    return (
        placed.select(
            F.col("id").alias(key), "text", "packed", "copy",
            F.lead("text").over(order).alias("next_text"), F.lead("packed").over(order).alias("next_packed"),
        )
        .where("copy = 0")
        .drop("copy")
    )


def edited_with_next(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many of the next text's first (or all)."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))
