"""An order of the comments of a discussion from its replies alone.

The replies of a discussion are a forest. Its Euler tour goes down to every
comment and up again, each step known from the comment itself: down to a first
reply comes after down to its parent, down to a later one after up from the reply
before it, up from a comment after up from its last reply. List ranking by
pointer doubling then counts the downs up to each step, which is the comment's
place: a parent before its replies, a reply with all below it before the next.

Every step is a row of three numbers; a round joins each open row with the one
row it points at, so no comment, however often it is answered, is a hot key.
Rounds grow with the logarithm of the longest discussion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.ordering import sequence
from parley.session import landed


def _families(nodes: DataFrame) -> DataFrame:
    """Per answered comment, missing or not: places of its first and last reply, and `head` and `parent`.

    `parent` is null for comments without a known parent; those follow the last
    comment of the family of roots before them, `head`, if their discussion has one.
    """
    ranges = nodes.groupBy("conv", "up").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    known = nodes.select(F.col("conv").alias("in_conv"), F.col("id"), F.col("pos").alias("parent"))
    same = F.col("conv").eqNullSafe(F.col("in_conv")) & (F.col("up") == F.col("id"))
    families = landed(ranges.join(known, same, "left").select("conv", "first", "last", "parent"), "thread-families")
    roots = sequence(families.where(F.col("parent").isNull()).select("conv", "first", "last"), ["first"], "at")
    before = roots.select((F.col("at") + 1).alias("at"), F.col("conv").alias("its"), F.col("last").alias("head"))
    heads = roots.join(before, "at").where(F.col("conv").eqNullSafe(F.col("its"))).select("first", "head")
    return landed(families.join(heads, "first", "left").drop("conv"), "thread-links")


def _tour(nodes: DataFrame, families: DataFrame) -> DataFrame:
    """Steps (step, before, downs): 2 * pos down to a comment, 2 * pos + 1 up from it, and the step before."""
    heads = families.select(F.col("first").alias("pos"), "parent", "head", F.lit(True).alias("is_first"))
    lasts = families.where(F.col("parent").isNotNull()).select(F.col("parent").alias("pos"), "last")
    rows = nodes.select("pos").join(heads, "pos", "left").join(lasts, "pos", "left")
    pos = F.col("pos")
    down = F.when(F.col("is_first"), F.coalesce(2 * F.col("parent"), 2 * F.col("head") + 1)).otherwise(2 * pos - 1)
    up = F.coalesce(2 * F.col("last") + 1, 2 * pos)
    steps = F.array(
        F.struct((2 * pos).alias("step"), down.alias("before"), F.lit(1).cast("long").alias("downs")),
        F.struct((2 * pos + 1).alias("step"), up.alias("before"), F.lit(0).cast("long").alias("downs")),
    )
    return rows.select(F.inline(steps))


def _ranked(tour: DataFrame) -> DataFrame:
    """Downs from the start of the list up to each step; steps that lead to no start keep a step before."""
    state = landed(tour, "thread-steps")
    n, open_steps = state.agg(F.count("*"), F.count("before")).first()
    reach = 1
    while open_steps and reach < n:
        there = state.select(F.col("step").alias("before"), F.col("before").alias("further"), F.col("downs").alias("more"))
        moved = state.where(F.col("before").isNotNull()).join(there, "before").select(
            "step", F.col("further").alias("before"), (F.col("downs") + F.col("more")).alias("downs")
        )
        state = landed(state.where(F.col("before").isNull()).union(moved), "thread-steps")
        open_steps, reach = state.agg(F.count("before")).first()[0], 2 * reach
    return state


def thread_places(
    comments: DataFrame, key: str = "conv_id", message: str = "message_id", parent: str = "reply_to",
    order: str | Column | None = None,
) -> DataFrame:
    """Per discussion and message id: ``place``, from 1, unique in the discussion.

    Replies to one comment are in the order of ``order``, then of their ids. A
    discussion begins with the comments that reply to none; replies to comments
    it does not hold follow, by the id of the missing comment. Of rows that share
    an id the smallest parent and order count. A comment that replies to itself,
    or above which replies go round in a circle, has no place. Rows without an
    id are left out.
    """
    by = F.lit(None).cast("string") if order is None else (F.col(order) if isinstance(order, str) else order)
    rows = (
        comments.where(F.col(message).isNotNull())
        .select(F.col(key).alias("conv"), F.col(message).alias("id"), F.col(parent).alias("up"), by.alias("by"))
        .groupBy("conv", "id")
        .agg(F.min("up").alias("up"), F.min("by").alias("by"))
    )
    nodes = landed(sequence(rows, ["conv", "up", "by", "id"], "pos").drop("by"), "thread-nodes")
    steps = _ranked(_tour(nodes, _families(nodes)))
    place = F.when(F.col("before").isNull(), F.col("downs")).alias("place")
    found = steps.where("step % 2 = 0").select((F.col("step") / 2).cast("long").alias("pos"), place)
    return nodes.join(found, "pos").select(F.col("conv").alias(key), F.col("id").alias(message), "place")


def with_place(
    comments: DataFrame, key: str = "conv_id", message: str = "message_id", parent: str = "reply_to",
    order: str | None = None, out: str = "place",
) -> DataFrame:
    """Add the place of a comment in its discussion; rows that share an id share it."""
    places = thread_places(comments, key, message, parent, order).toDF("_conv", "_message", "_place")
    same = F.col(key).eqNullSafe(F.col("_conv")) & (F.col(message) == F.col("_message"))
    return comments.join(places, same, "left").withColumn(out, F.col("_place")).drop("_conv", "_message", "_place")
