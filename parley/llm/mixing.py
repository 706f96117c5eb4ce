"""Mixing sources to target weights: blocks of tokens, drawn shard by shard and joined by index.

Tokens are words between blanks. The documents of a source, in a fixed order,
make one stream; the stream is cut into blocks of `block` words (the last one
may be shorter). A source's slots are its target in blocks; every slot draws
its output shard, so a source's counts over the shards are multinomial and its
total is exact. In the order of the shards, slot j of a source is epoch
j div blocks, position j mod blocks; each epoch has its own pseudorandom
permutation of the block numbers (swap-or-not, a permutation of any range
without tables). Slots meet the pieces of documents by (source, block).

Only DataFrame operations run. Every draw is a hash of (seed, source, number),
so reruns agree. A source with a third of all words is spread: its stream is
laid out over buckets of documents, its slots over chunks, its joins over blocks.

Defined cases: a null text has no words and is never taken; a null source is a
source of its own, last in order; a null id is an id; rows may repeat, each is
a document (one id repeated over a large part of all rows would make one
large bucket). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.oph import let, words
from parley.llm.shared import landed, sorted_side

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK = 64
SEED = 42
ROUNDS = 24
ROWS_PER_BUCKET = 2_048
SLOTS_PER_SHARD = 4_096
SLOTS_PER_CHUNK = 16_384


@dataclass(frozen=True)
class Mix:
    """The parts of a mix, each a table.

    sources: source, source_size, weight, target, blocks, slots.
    documents: id, source, size, text_hash, start (word offset in its source's stream).
    slots: shard, source, slot, epoch, block.
    pieces: id, source, size, text_hash, start, block, first (word in the document, from 0), n_words.
    """

    sources: DataFrame
    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame


def sizes(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(
        F.col(key).cast("long").alias("id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(body).alias("text_hash"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS, block: int = BLOCK) -> DataFrame:
    """Target words of each source: shares by weight, none above `cap` times its size.

    Ordered by cap per weight, the sources that reach their cap come first, so
    the level at which the rest shares by weight is found in one pass over
    running sums. The windows hold one row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(w) for w in weights])
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sized = sized.select(
        "*", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)).cast("double").alias("weight")
    ).withColumn("reach", F.col("source_size") * float(cap) / F.col("weight"))
    zero = F.lit(0.0)
    levels = sized.select(
        "*", F.row_number().over(by_cap).alias("place"),
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * float(cap)).over(before), zero))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
        ).alias("level"),
    )
    fits = F.when(F.col("level") <= F.col("reach"), F.struct("place", "level"))
    out = levels.select("*", F.min(fits).over(everything)["level"].alias("shared"))
    target = F.coalesce(F.least(F.col("source_size") * float(cap), F.col("weight") * F.col("shared")), zero)
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks")))
    return (
        out.select("source", "source_size", "weight", target.alias("target"))
        .withColumn("blocks", blocks)
        .withColumn("slots", F.coalesce(slots, zero).cast("long"))
    )


def laid_out(rows: DataFrame, n_rows: int) -> DataFrame:
    """Each document's word offset in the stream of its source.

    Sums run inside buckets of documents; the buckets' own offsets come from
    one row per source and bucket.
    """
    buckets = max(1, -(-n_rows // ROWS_PER_BUCKET))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    inside = (
        Window.partitionBy("source", "bucket").orderBy("id", "size", "text_hash")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    bases = bases.select(
        F.col("source").alias("of"), F.col("bucket").alias("in"),
        F.coalesce(F.sum("words").over(across), F.lit(0)).alias("base"),
    )
    rows = rows.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(
        bases, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in"))
    ).select("id", "source", "size", "text_hash", (F.col("base") + F.col("local")).alias("start"))


def permuted(position: Column, n: Column, *key: Column) -> Column:
    """Image of a position under a pseudorandom permutation of 0 .. n-1.

    Each round pairs x with k - x (mod n) and swaps the pair or not by a hash
    of its larger member, so every round, and thus the whole, is one to one.
    """

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)

        def swapped(y: Column) -> Column:
            coin = F.xxhash64(*key, r, F.greatest(x, y)).bitwiseAND(F.lit(1).cast("long"))
            return F.when(coin == 1, y).otherwise(x)

        return let(partner, swapped)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), position, step)


def drawn_slots(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """Slots with the output shard they were drawn for and the block they take."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // SLOTS_PER_SHARD))
    own = sources.where("slots > 0").select("source", "blocks", "slots", F.xxhash64("source").alias("name"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(SLOTS_PER_CHUNK).cast("long")))
    chunks = own.select("*", chunk.alias("at")).repartition("name", "at")
    last = F.least(F.col("at") + SLOTS_PER_CHUNK, F.col("slots")) - 1
    draws = chunks.select("source", "blocks", "name", F.explode(F.sequence("at", last)).alias("n"))
    shard = F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "name", "n"), F.lit(shards))
    counts = draws.groupBy("source", "blocks", "name", shard.alias("shard")).agg(F.count("*").alias("count"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("count").over(before), F.lit(0).cast("long"))
    # A few bytes stand for thousands of slots: keep all tasks, which runtime re-planning would merge.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = counts.withColumn("offset", offset).repartition(tasks, "name", "shard")
    slots = placed.select(
        "shard", "source", "blocks", "name",
        F.explode(F.sequence("offset", F.col("offset") + F.col("count") - 1)).alias("slot"),
    ).withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")))
    block = permuted(
        F.pmod("slot", "blocks"), F.col("blocks"), F.lit(seed), F.col("name"), F.col("epoch")
    )
    return slots.select("shard", "source", "slot", "epoch", block.alias("block"))


def pieces(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """Parts of documents by the block of their source that they lie in."""
    end = F.col("start") + F.col("size")
    numbers = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    at = F.greatest(F.col("start"), F.col("block") * block)
    return (
        documents.where("size > 0")
        .select("*", F.explode(numbers).alias("block"))
        .select(
            "*", (at - F.col("start")).alias("first"),
            (F.least(end, (F.col("block") + 1) * block) - at).alias("n_words"),
        )
    )


def mix(
    docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text",
    weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS, block: int = BLOCK, seed: int = SEED,
) -> Mix:
    rows = landed(sizes(docs, key, source, text), "mix-sizes")
    sources = landed(targets(rows, weights, cap, block), "mix-sources")
    documents = landed(laid_out(rows, rows.count()), "mix-documents")
    slots = landed(drawn_slots(sources, seed), "mix-slots")
    return Mix(sources, documents, slots, pieces(documents, block))


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def taken_words(plan: Mix) -> DataFrame:
    """Per document: id, source, size, source_size, target, and the words taken, repeats counted."""
    takes = plan.slots.groupBy("source", "block").agg(F.count("*").alias("takes"))
    same = _same_source(plan.pieces, takes) & (plan.pieces["block"] == takes["block"])
    found = sorted_side(plan.pieces).join(takes, same, "left").select(
        plan.pieces["id"], plan.pieces["source"], "size", "text_hash", "start",
        (F.col("n_words") * F.coalesce("takes", F.lit(0))).alias("words"),
    )
    summed = found.groupBy("id", "source", "size", "text_hash", "start").agg(F.sum("words").alias("taken"))
    out = summed.select("id", "source", "size", "taken").union(
        plan.documents.where("size = 0").select("id", "source", "size", F.lit(0).cast("long").alias("taken"))
    )
    sources = plan.sources.select(F.col("source").alias("of"), "source_size", "target")
    return out.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def mixed_texts(
    docs: DataFrame, plan: Mix, *, key: str = "doc_id", source: str = "source", text: str = "text",
    n_chars: str = "n_chars",
) -> DataFrame:
    """The mix as documents: for every epoch that takes from a document, a row with what it takes.

    All columns pass through; the text is the whole text if the epoch takes all
    of it, else the taken words joined by blanks, and `n_chars` its length. Of rows
    that share id, source and text, which count as one, any one's other columns are kept.
    """
    same = _same_source(plan.pieces, plan.slots) & (plan.pieces["block"] == plan.slots["block"])
    parts = sorted_side(plan.pieces).join(plan.slots, same).select(
        plan.pieces["id"], plan.pieces["source"], "size", "text_hash", "start", "epoch", "first", "n_words"
    )
    # No more parts in a group than a text has blocks.
    drawn = parts.groupBy("id", "source", "size", "text_hash", "start", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("first", "n_words"))).alias("_mix_parts"),
        (F.sum("n_words") == F.col("size")).alias("_mix_whole"),
    )
    drawn = drawn.select(F.struct("id", "source", "text_hash").alias("_mix_at"), "_mix_parts", "_mix_whole")
    # Texts move once, by this key: repeated rows and the join share the partitioning. Nulls in it are equal.
    at = F.struct(
        F.col(key).cast("long").alias("id"), F.col(source).cast("string").alias("source"),
        F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
    ).cast(drawn.schema["_mix_at"].dataType)
    # The row travels as one struct, so that no name of its columns can clash.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    texts = docs.select(row.alias("row"), at.alias("_mix_key")).repartition("_mix_key").dropDuplicates(["_mix_key"])
    rows = texts.join(drawn, F.col("_mix_key") == F.col("_mix_at"))
    body = F.col("row").getField(text).cast("string")
    chosen = let(
        words(body),
        lambda all_words: F.array_join(
            F.flatten(
                F.transform(
                    F.col("_mix_parts"),
                    lambda p: F.slice(all_words, (p.getField("first") + 1).cast("int"), p.getField("n_words").cast("int")),
                )
            ),
            " ",
        ),
    )
    rows = rows.select("row", F.when(F.col("_mix_whole"), body).otherwise(chosen).alias("taken"))
    own = {c: F.col("row").getField(c) for c in docs.columns} | {text: F.col("taken")}
    if n_chars in docs.columns:
        own[n_chars] = F.char_length("taken").cast(docs.schema[n_chars].dataType)
    return rows.select(*[value.alias(c) for c, value in own.items()])
