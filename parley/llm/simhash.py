"""SimHash near-duplicates: block keys by the pigeonhole principle, then Hamming distance.

A fingerprint of 64 bits is split into seven blocks. Two fingerprints that
differ in at most four bits agree on at least three whole blocks, so they share
one of the 35 keys made of three blocks (27 or 28 bits). Only different
fingerprints are keyed: copies never meet. Keys with one member are dropped by
a count that is combined on the map side; the others are joined with
themselves, and a pair is verified under the first key it shares only.

A key with more than `dense` members (a large group of near copies) would cost
the square of its size. Its members are linked by midpoints instead: two
fingerprints differ in at most four bits exactly if some 64 bit value differs
from each in at most two, so every member is put under its 2081 values of that
kind and linked with the smallest member there. No link is lost and the work is
in proportion to the members. Groups are the connected components of the links.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; fewer words than a shingle are
hashed as one sequence. A null id counts as the largest; its group's id is null
only if all ids of the group are null. `keep_first` keeps one row of each
group, null ids and unlike texts of one id included. Texts are read whole. Other columns are not read
(`groups`) or pass through (`keep_first`).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.components import components
from parley.llm.shared import landed, sorted_side

SHINGLE_WORDS = 4
SEED = 42
BITS = 64
BLOCKS = 7
DISTANCE = 4
# Members of a key from which midpoints are cheaper than pairs.
DENSE = 4_096
# Shingles whose bits are counted at once.
CHUNK = 65_536
NO_ID = (1 << 63) - 1


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bits set in more than half of the hashes of a text's word shingles, as a signed number."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array(
            [digest(join(found[i : i + words]), SEED) for i in range(at, min(n, at + CHUNK))], "<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(text: Column, words: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf("long")
    def simhash_fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return simhash_fingerprint(text)


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), BITS // 4, "0"))


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def block_masks(blocks: int = BLOCKS) -> list[int]:
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    return [_signed((1 << b) - (1 << a)) for a, b in itertools.pairwise(edges)]


def _keyed(fps: DataFrame, distance: int) -> DataFrame:
    """One row per fingerprint and key: `last` (the key's last block), `key`, `fp`."""
    masks = block_masks()
    keys = [
        F.struct(
            F.lit(combo[-1]).cast("byte").alias("last"),
            F.lit(n).cast("byte").alias("combo"),
            F.col("fp").bitwiseAND(F.lit(_signed(sum(masks[i] % (1 << BITS) for i in combo)))).alias("bits"),
        )
        for n, combo in enumerate(itertools.combinations(range(BLOCKS), BLOCKS - distance))
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")


def _pairs(members: DataFrame, distance: int) -> DataFrame:
    """Verified pairs of each key; a pair that shares several keys is made under the first."""
    other = members.select("combo", "bits", F.col("fp").alias("fp_b"))
    rows = members.select("combo", "bits", "last", F.col("fp").alias("fp_a"))
    differs = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    # The key's blocks are the first equal ones if no more blocks up to its last one are equal.
    equal_blocks = sum(
        ((F.lit(i) <= F.col("last")) & (differs.bitwiseAND(F.lit(mask)) == 0)).cast("int")
        for i, mask in enumerate(block_masks())
    )
    return sorted_side(rows).join(
        other,
        (rows["combo"] == other["combo"])
        & (rows["bits"] == other["bits"])
        & (F.col("fp_a") < F.col("fp_b"))
        & (F.bit_count(differs) <= distance)
        & (equal_blocks == BLOCKS - distance),
    ).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))


def _midpoint_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links of every fingerprint with the smallest one that shares a midpoint with it."""
    reach = distance // 2
    single = F.array(*[F.lit(_signed(1 << i)) for i in range(BITS)])
    flips = F.array(F.lit(0).cast("long"))
    for _ in range(reach):
        more = F.transform(flips, lambda x: F.transform(single, lambda y: x.bitwiseXOR(y)))
        flips = F.array_union(flips, F.flatten(more))
    spread = fps.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle")
    )
    smallest = landed(spread.groupBy("middle").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "midpoints")
    return sorted_side(spread).join(smallest, "middle").where("fp <> b").select(F.col("fp").alias("a"), "b")


def links(fps: DataFrame, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column `fp`.

    Every pair within the distance is linked, directly or, in dense keys, over
    others that are within the distance of their neighbours.
    """
    if distance % 2 or not 0 <= distance < BLOCKS:
        raise ValueError(f"the distance must be even and below {BLOCKS}")
    keyed = _keyed(fps, distance)
    shared = keyed.groupBy("combo", "bits").agg(F.count("*").alias("n")).where("n > 1")
    members = landed(sorted_side(keyed).join(shared, ["combo", "bits"]), "simhash-keys")
    crowd = members.where(F.col("n") > dense).select("fp").distinct()
    return _pairs(members.where(F.col("n") <= dense), distance).union(_midpoint_links(crowd, distance))


def _components(rows: DataFrame, distance: int, dense: int) -> DataFrame:
    """Per distinct `fp` of the rows: `root`, its component, and `component`, the smallest id there."""
    firsts = landed(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-firsts")
    roots = components(links(firsts.select("fp"), distance, dense))
    rooted = landed(
        sorted_side(firsts).join(roots, firsts["fp"] == roots["node"], "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        ),
        "simhash-roots",
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return landed(sorted_side(rooted).join(smallest, "root").select("fp", "root", "component"), "simhash-components")


def groups(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", distance: int = DISTANCE,
    words: int = SHINGLE_WORDS, dense: int = DENSE,
) -> DataFrame:
    """Per row: id, `fp`, and `component_id`, the smallest id reachable over links."""
    rows = landed(
        docs.select(
            F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"),
            fingerprints(F.col(text).cast("string"), words).alias("fp"),
        ),
        "simhash",
    )
    named = _components(rows, distance, dense).drop("root")
    return sorted_side(rows).join(named, "fp").select(
        F.nullif("id", F.lit(NO_ID)).alias(key), "fp", F.nullif("component", F.lit(NO_ID)).alias("component_id")
    )


def chosen_rows(docs: DataFrame, wanted: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows named by (`id`, `unit`), unit being the 64 bit hash of the text; of repeated rows one.

    Texts move once, by id and hash: the join and the choice share that
    partitioning. Null ids are equal to each other and spread by their texts.
    """
    own = F.col(key).cast("long")
    # The row travels as one struct, so that no name of its columns can clash.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(own, F.lit(0)).alias("id"),
        own.isNull().alias("none"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("unit"),
    )
    named = wanted.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"), "unit")
    at = ["id", "none", "unit"]
    return sorted_side(rows).join(named, at, "left_semi").dropDuplicates(at).select("row.*")


def keep_first(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", distance: int = DISTANCE,
    words: int = SHINGLE_WORDS, dense: int = DENSE,
) -> DataFrame:
    """One row of each group: the one with the smallest id. All columns pass through.

    Of rows of one group and id the smallest hash of the text decides, so an id
    with unlike texts stays once in each group it is the smallest of.
    """
    own = F.col(text).cast("string")
    rows = landed(
        docs.select(
            F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(key).isNull().alias("none"),
            fingerprints(own, words).alias("fp"), F.xxhash64(F.coalesce(own, F.lit(""))).alias("unit"),
        ),
        "simhash",
    )
    smallest = F.min(F.struct("id", "none", "unit")).alias("s")
    firsts = landed(rows.groupBy("fp").agg(smallest), "simhash-smallest")
    rooted = sorted_side(firsts).join(_components(rows, distance, dense), "fp")
    kept = rooted.groupBy("root").agg(F.min("s").alias("s")).select(
        F.when(~F.col("s.none"), F.col("s.id")).alias("id"), "s.unit"
    )
    return chosen_rows(docs, landed(kept, "simhash-kept"), key=key, text=text)
