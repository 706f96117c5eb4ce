"""Chat formatting: a dialogue of several speakers seen from each of them in turn.

For every participant the dialogue is rendered with that speaker's turns as the
assistant's and the others' as those of named users; only the assistant's own
words and the end mark after them count for the loss. Turns of the system
speaker belong to every perspective and are nobody's. One row is one turn of one
perspective, with its place in the rendered dialogue; joining the rows in order
of `start` gives the dialogue, and no task ever holds a whole one.

Only DataFrame operations run. Places are running sums inside buckets of turns
plus the totals of earlier buckets, so a conversation with a third of all turns
is spread over many tasks.

Defined cases: a null text is empty; a null speaker is a participant without a
name; a null conversation id is a conversation of its own; a null turn comes
first. Turns with the same number are ordered by speaker and text (nulls
first); repeated rows are repeated turns. A conversation of system turns only
has no perspective. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.shared import bucket_of, landed, order_buckets

SYSTEM = "system"
# Marks of a turn (fixed values of a common chat format).
BEGIN, END = "<|im_start|>", "<|im_end|>"


def rotate(
    turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role",
    text: str = "text", system: str = SYSTEM,
) -> DataFrame:
    """conv_id, perspective, turn, role, name, rendered, start, mask_from, mask_to (in characters).

    mask_from and mask_to bound what the loss counts; they are equal where it counts nothing.
    """
    rows = turns.select(
        F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.col(speaker).cast("string").alias("speaker"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    people = rows.where(~F.col("speaker").eqNullSafe(F.lit(system))).select(
        F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")
    ).distinct()
    widths = order_buckets(rows, "conv_id", "turn")
    views = landed(people.join(widths, F.col("_conv").eqNullSafe(F.col("_group"))).drop("_group"), "perspectives")
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    is_system = F.col("speaker").eqNullSafe(F.lit(system))
    role = F.when(is_system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(~is_system & ~own, F.coalesce("speaker", F.lit("")))
    head = F.concat(
        F.lit(BEGIN), role, F.when(name != "", F.concat(F.lit(" name="), name)).otherwise(F.lit("")), F.lit("\n")
    )
    seen = rows.join(views, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "perspective", "turn", "speaker", "text", role.alias("role"), name.alias("name"),
        head.alias("head"), bucket_of("turn").alias("bucket"),
    )
    seen = seen.withColumn("rendered", F.concat("head", "text", F.lit(f"{END}\n")))
    inside = (
        Window.partitionBy("conv_id", "perspective", "bucket").orderBy("turn", "speaker", "text")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy("conv_id", "perspective").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("long")
    size = F.char_length("rendered").cast("long")
    totals = seen.groupBy("conv_id", "perspective", "bucket").agg(F.sum(size).alias("chars"))
    totals = totals.select(
        F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("bucket").alias("_b"),
        F.coalesce(F.sum("chars").over(across), zero).alias("base"),
    )
    placed = seen.withColumn("local", F.coalesce(F.sum(size).over(inside), zero)).join(
        totals,
        F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("perspective").eqNullSafe(F.col("_p"))
        & (F.col("bucket") == F.col("_b")),
    )
    start = F.col("base") + F.col("local")
    body = start + F.char_length("head")
    counted = F.when(F.col("role") == "assistant", F.char_length("text") + len(END)).otherwise(F.lit(0))
    return placed.select(
        "conv_id", "perspective", "turn", "role", "name", "rendered", start.alias("start"),
        body.alias("mask_from"), (body + counted).alias("mask_to"),
    )
