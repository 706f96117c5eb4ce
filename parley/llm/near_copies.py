"""Near copies by exact similarity: SimHash and banded MinHash find candidates, shingle sets decide.

Two texts are near copies if the sets of their five-word shingles (blanks
separate words, ASCII letters in lower case) have a Jaccard similarity of at
least 0.8. Every distinct text gets 36 keys of six minima each; a pair at 0.8
shares no key with probability 0.00002 and is compared if it shares one. Only
pairs whose sets pass are linked, so groups are the components of true links.

SimHash (`simhash`, over the same shingles) comes first: its groups are the components of
fingerprints that differ in at most four bits, and every text is compared with the first one
of its group. Four bits reach only the closest copies, so the keys find the others.

Texts of one key are first compared with its most central text only, the one whose
keys hold most texts: a group around it is linked in as many pairs as it has
texts. What then is still in several groups is compared in full, so no candidate is dropped. Full
comparison reads a bitmap of 2,048 bits a text first: a bit that only one of
two texts has stands for a shingle that only that one has, so the bits that differ
are at most the shingles that differ. The join condition drops pairs that differ in more
than similarity allows, which loses no link, and only the others' sets are read.

Defined cases: a null text counts as empty; texts without words are copies of
each other and of no other text; fewer words than a shingle are one shingle of
all words. Texts count as equal if their 64 bit hashes are. Of each group the
row with the smallest id stays (a null id counts as the largest; ties: the
smallest hash of the text), of repeated rows one. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import oph, simhash
from parley.llm.components import components
from parley.llm.shared import handed_back, landed, sorted_side
from parley.llm.simhash import chosen_rows

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, MINIMA = 36, 6
SEED = 7
# Bits of a text's bitmap, in numbers of 64.
WORDS = 32
# Shingles whose minima are taken at once.
CHUNK = 2_048
# Rows of a batch that are Python objects at once.
SLICE_ROWS = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64)


def sketch(text: str | None, words: int = SHINGLE_WORDS) -> tuple[list[int], list[int], int]:
    """One key per band (the hash of its smallest shingle hashes), the bitmap, and the number of shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    minima = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(found) - words + 1) if found else 0
    seen = []
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(join(found[i : i + words]), SEED) for i in range(at, min(n, at + CHUNK))], np.uint64)
        seen.append(hashes)
        with np.errstate(over="ignore"):
            for k in range(BANDS * MINIMA):
                minima[k] = min(minima[k], (hashes * _FACTORS[k] + _TERMS[k]).min())
    parts = minima.astype("<u8").reshape(BANDS, MINIMA)
    keys = np.array([digest(part.tobytes(), band) for band, part in enumerate(parts)], np.uint64)
    distinct = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
    bits = np.zeros(WORDS * 64, bool)
    bits[(distinct % np.uint64(WORDS * 64)).astype(np.int64)] = True
    bitmap = np.packbits(bits).view("<i8")
    return keys.view(np.int64).tolist(), bitmap.tolist(), len(distinct)


def band_keys(text: str | None, words: int = SHINGLE_WORDS) -> list[int]:
    return sketch(text, words)[0]


def sketched(batches: Iterator[pa.Array], words: int) -> Iterator[pa.Array]:
    """Sketch and SimHash of every text, a slice of a batch at a time."""
    longs = pa.list_(pa.int64())
    for batch in handed_back(batches):
        for at in range(0, len(batch), SLICE_ROWS):
            texts = batch.slice(at, SLICE_ROWS).to_pylist()
            keys, bits, sizes, fps = zip(*[(*sketch(t, words), simhash.fingerprint(t, words)) for t in texts])
            yield pa.StructArray.from_arrays(
                [pa.array(keys, longs), pa.array(bits, longs), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64())],
                ["keys", "bits", "n", "fp"],
            )


def _sketches(text: Column, words: int) -> Column:
    @F.arrow_udf("keys array<long>, bits array<long>, n int, fp long")
    def simhash_and_minhash_bands(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from sketched(batches, words)

    return simhash_and_minhash_bands(text)


def _shingles(text: Column, words: int) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    none = F.array().cast("array<bigint>")
    return F.coalesce(F.array_distinct(oph.shingle_hashes(lowered, words)), none)


def _may_be_alike(similarity: float, a: str = "a", b: str = "b") -> Column:
    """Whether sizes and bitmaps allow the similarity; false only if it is certainly below."""
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    differ = [F.bit_count(F.get(f"bits_{a}", F.lit(k)).bitwiseXOR(F.get(f"bits_{b}", F.lit(k)))) for k in range(WORDS)]
    # With J = common / either, the shingles of one text alone are (1 - J) / (1 + J) of both sizes; half a shingle for rounding.
    most = F.lit((1 - similarity) / (1 + similarity)) * (n_a + n_b) + 0.5
    sizes = F.least(n_a, n_b) + 0.5 >= F.lit(similarity) * F.greatest(n_a, n_b)
    return sizes & (sum(differ[1:], differ[0]) <= most)


def _with_facts(pairs: DataFrame, facts: DataFrame, *names: str) -> DataFrame:
    for name in names:
        own = facts.select(F.col("unit").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
        pairs = pairs.join(sorted_side(own), name)
    return pairs


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    one = sets.select(F.col("unit").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("unit").alias("b"), F.col("set").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - common
    passes = (either == 0) | (common / either >= similarity)
    return pairs.join(sorted_side(one), "a").join(sorted_side(two), "b").where(passes).select("a", "b")


def _with_roots(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (band key, unit) with the root of their unit under the links."""
    roots = components(links).withColumnRenamed("node", "unit")
    return sorted_side(members).join(roots, "unit", "left").select("key", "unit", F.coalesce("root", "unit").alias("root"))


def _open_keys(members: DataFrame) -> DataFrame:
    """Per key whose texts are in several groups: number of texts and its largest group."""
    per_root = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    per_key = per_root.groupBy("key").agg(
        F.sum("n").alias("n"), F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("most")
    )
    return per_key.where("roots > 1").drop("roots")


def _led_pairs(members: DataFrame) -> DataFrame:
    """Pairs of a key's most central text with the other texts of its key."""
    per_key = members.groupBy("key").agg(F.count("*").alias("n"))
    crowd = landed(sorted_side(members).join(per_key, "key"), "copies-crowd")
    scores = crowd.groupBy("unit").agg(F.sum("n").alias("score"))
    leaders = landed(
        sorted_side(crowd).join(scores, "unit").groupBy("key").agg(F.max_by("unit", F.struct("score", "unit")).alias("leader")),
        "copies-leaders",
    )
    pairs = sorted_side(crowd).join(leaders, "key").where("unit <> leader")
    return pairs.select(F.greatest("unit", "leader").alias("a"), F.least("unit", "leader").alias("b")).distinct()


def _simhash_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of the first text of a SimHash group with the other texts of the group: as many as texts."""
    roots = components(simhash.links(rows.select("fp").distinct()))
    own = sorted_side(rows.select("unit", "fp")).join(roots, F.col("fp") == F.col("node"), "left")
    grouped = landed(own.select("unit", F.coalesce("root", "fp").alias("group")), "copies-simhash")
    firsts = grouped.groupBy("group").agg(F.min("unit").alias("first"))
    pairs = sorted_side(grouped).join(firsts, "group").where("unit <> first")
    return landed(pairs.select(F.col("unit").alias("a"), F.col("first").alias("b")), "copies-simhash-pairs")


def links(rows: DataFrame, sets_of, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between the distinct texts of rows (`unit`, `keys`, `bits`, `n`, `fp`); `sets_of` makes their shingle sets."""
    closest = _simhash_pairs(rows)
    keyed = rows.select("unit", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = landed(sorted_side(keyed).join(shared, "key"), "copies-keys")
    paired = closest.select(F.explode(F.array("a", "b")).alias("unit"))
    units = landed(members.select("unit").union(paired).distinct(), "copies-units")
    facts = landed(sorted_side(rows.select("unit", "n", "bits")).join(units, "unit", "left_semi"), "copies-facts")
    sets = landed(sets_of(units), "copies-sets")
    led = closest.union(_led_pairs(members)).distinct()
    near = _with_facts(led, facts, "a", "b").where(_may_be_alike(similarity)).select("a", "b")
    found = landed(_alike(landed(near, "copies-pairs"), sets, similarity), "copies-links")
    members = landed(_with_roots(members, found), "copies-keys")
    # Each pair of one key and two groups: texts outside the key's largest group with all others.
    tables = landed(_open_keys(members).select("key", "most"), "copies-open")
    live = landed(sorted_side(members).join(tables, "key").join(sorted_side(facts), "unit"), "copies-live")
    one = live.where("root <> most").select(
        "key", F.col("unit").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")
    )
    two = live.select(
        "key", F.col("unit").alias("b"), F.col("root").alias("root_b"), "most", F.col("n").alias("n_b"),
        F.col("bits").alias("bits_b"),
    ).withColumnRenamed("key", "of_key")
    met = F.col("key") == F.col("of_key")
    apart = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("most")) | (F.col("a") > F.col("b")))
    pairs = sorted_side(one).join(two, met & apart & _may_be_alike(similarity))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return found.union(_alike(landed(pairs, "copies-pairs"), sets, similarity))


def drop(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row of each group of near copies. All columns pass through."""
    own = F.col(text).cast("string")
    rows = landed(
        docs.select(
            F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce(own, F.lit(""))).alias("unit"),
            _sketches(own, words).alias("s"),
        ).select("id", "unit", "s.keys", "s.bits", "s.n", "s.fp"),
        "copies",
    )
    # Copies collapse to the row with the smallest id.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))).alias("first")
    units = landed(
        rows.groupBy("unit")
        .agg(first, *[F.first(c).alias(c) for c in ("keys", "bits", "n", "fp")])
        .select("unit", "first.id", "keys", "bits", "n", "fp"),
        "copies-texts",
    )

    def sets_of(wanted: DataFrame) -> DataFrame:
        named = sorted_side(units).join(wanted, "unit", "left_semi").select("id", "unit")
        texts = chosen_rows(docs, landed(named, "copies-named"), key=key, text=text)
        return texts.select(
            F.xxhash64(F.coalesce(own, F.lit(""))).alias("unit"), _shingles(own, words).alias("set")
        )

    roots = landed(components(links(units, sets_of, similarity)), "copies-roots")
    rooted = sorted_side(units).join(roots, units["unit"] == roots["node"], "left").select(
        "id", "unit", F.coalesce("root", "unit").alias("root")
    )
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("unit").alias("unit")))
    kept = rooted.groupBy("root").agg(smallest.alias("s")).select("s.id", "s.unit")
    return chosen_rows(docs, landed(kept, "copies-kept"), key=key, text=text)
