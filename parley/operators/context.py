"""Reply chains: ancestors, context text, context length, intervention label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import null_as_word, truncate_comment
from parley.operators.ordering import keep_first, next_value
from parley.session import work_path

# Most targets whose ids are sent to every executor; more are joined by a shuffle.
SMALL_TARGETS = 100_000


def unique_lookup(lookup: DataFrame, order: list[str]) -> DataFrame:
    """One row per message id, so a chain never forks."""
    return keep_first(lookup, ["message_id"], order)


def _step(chain: DataFrame, links: DataFrame, current: str, out: str) -> DataFrame:
    """Add the parent of ``current``; null at a root or an unknown id.

    Of rows that share an id the smallest parent counts, so a chain never forks.
    """
    parents = links.groupBy(F.col("message_id").alias("_id")).agg(F.min("reply_to").alias(out))
    # A quarter of all comments are roots. Joined on null they would all land
    # in one partition, so they are spread by their own id and kept apart by
    # the second condition.
    key = F.coalesce(F.col(current), F.col("target_id"))
    return chain.join(
        parents, (key == F.col("_id")) & F.col(current).isNotNull(), "left"
    ).drop("_id")


def _small_step(chain: DataFrame, links: DataFrame, current: str, out: str) -> DataFrame:
    """The same step for few targets: the lookup is scanned, never shuffled."""
    wanted = F.broadcast(chain.select(F.col(current).alias("message_id")).dropna().distinct())
    found = links.join(wanted, "message_id").groupBy(F.col("message_id").alias(current)).agg(
        F.min("reply_to").alias(out)
    )
    return chain.join(F.broadcast(found), current, "left")


def ancestors(
    targets: DataFrame, lookup: DataFrame, hops: int = 3, small_targets: bool = False
) -> DataFrame:
    """Up to ``hops`` ancestor ids of every target: (target_id, hop, message_id).

    Only ids move here. The last id of a chain may be unknown to the lookup;
    the caller's own join drops it. ``small_targets`` promises that the caller
    has bounded the targets (see SMALL_TARGETS).
    """
    step = _small_step if small_targets else _step
    links = lookup.select("message_id", "reply_to")
    chain = targets.select(
        F.col("message_id").alias("target_id"), F.col("reply_to").alias("a1")
    )
    for hop in range(1, hops):
        chain = step(chain, links, f"a{hop}", f"a{hop + 1}")
    steps = F.array(
        *[
            F.struct(F.lit(hop).alias("hop"), F.col(f"a{hop}").alias("message_id"))
            for hop in range(1, hops + 1)
        ]
    )
    return chain.select(
        "target_id", F.inline(F.filter(steps, lambda s: s["message_id"].isNotNull()))
    )


def reply_depth(comments: DataFrame) -> DataFrame:
    """(message_id, depth): replies between a comment and the start of its chain.

    The order of a discussion without turn numbers. Every round doubles the
    distance that is known, so the rounds grow with the logarithm of the
    longest chain; each is written to the shared folder. Comments whose parent
    is missing or unknown have depth 0. Comments on a cycle, or above one, have
    none. Of rows that share an id the smallest parent counts.
    """
    spark = comments.sparkSession
    links = comments.groupBy("message_id").agg(F.min("reply_to").alias("up")).where("message_id is not null")
    known = links.select(F.col("message_id").alias("_id"))
    state = _written(
        links.join(known, F.col("up") == F.col("_id"), "left").select(
            "message_id", F.col("_id").alias("up"), F.when(F.col("_id").isNull(), 0).otherwise(1).cast("long").alias("depth")
        ),
        spark,
    )
    n, open_ends = state.agg(F.count("*"), F.count("up")).first()
    reach = 1
    while open_ends and reach < 2 * n:
        above = state.select(F.col("message_id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_more"))
        state = _written(
            state.join(above, F.col("up") == F.col("_id"), "left").select(
                "message_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")
            ),
            spark,
        )
        open_ends, reach = state.agg(F.count("up")).first()[0], 2 * reach
    return state.select("message_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def _written(df: DataFrame, spark) -> DataFrame:
    path = work_path(spark, "chains")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _found(
    targets: DataFrame, lookup: DataFrame, hops: int, small_targets: bool, payload: Column
) -> DataFrame:
    chain = ancestors(targets, lookup, hops, small_targets)
    if small_targets:
        chain = F.broadcast(chain)
    found = lookup.select("message_id", payload.alias("_payload")).join(chain, "message_id")
    # Of rows that share an id the smallest payload counts. Partitioning by
    # target alone serves this grouping and the caller's.
    return found.repartition("target_id").groupBy("target_id", "hop").agg(F.min("_payload").alias("_payload"))


def with_context(
    targets: DataFrame,
    lookup: DataFrame,
    hops: int = 3,
    max_chars: int = 3000,
    small_targets: bool = False,
) -> DataFrame:
    """Add ``n_ancestors`` and ``discussion``, the tagged context and target.

    Oldest ancestor first. Ids are walked first and every text is fetched once,
    cut to length at the scan. Rows of ``lookup`` that share a message id count
    once, with the smallest parent and text; ``unique_lookup`` keeps the first.
    """
    text = truncate_comment(null_as_word(F.col("text")), max_chars)
    found = _found(targets, lookup, hops, small_targets, text)
    # At most ``hops`` rows per target.
    context = (
        found.groupBy("target_id")
        .agg(F.sort_array(F.collect_list(F.struct("hop", "_payload")), asc=False).alias("_found"))
        .select(F.col("target_id").alias("message_id"), "_found")
    )
    tagged = F.transform(
        "_found", lambda a: F.concat(F.lit("<CTX>"), a["_payload"], F.lit("</CTX>"))
    )
    target = F.concat(F.lit("<TGT>"), text, F.lit("</TGT>"))
    return (
        targets.join(context, "message_id", "left")
        .withColumn("n_ancestors", F.coalesce(F.size("_found"), F.lit(0)).cast("long"))
        .withColumn("n_ancestors", F.greatest("n_ancestors", F.lit(0).cast("long")))
        .withColumn("discussion", F.concat_ws(" ", tagged, target))
        .drop("_found")
    )


def with_context_length(
    targets: DataFrame, lookup: DataFrame, hops: int = 3, small_targets: bool = False
) -> DataFrame:
    """Add ``est_length``: uncut characters of the target and its ancestors.

    Lengths are taken at the scan, so no text is shuffled.
    """
    size = F.char_length(null_as_word(F.col("text"))).cast("long")
    context = (
        _found(targets, lookup, hops, small_targets, size)
        .groupBy("target_id")
        .agg(F.sum("_payload").alias("_context"))
        .withColumnRenamed("target_id", "message_id")
    )
    return (
        targets.withColumn("_own", size)
        .join(context, "message_id", "left")
        .withColumn("est_length", F.col("_own") + F.coalesce("_context", F.lit(0)))
        .drop("_own", "_context")
    )


def intervention_label(
    comments: DataFrame, key: str = "conv_id", position: str = "turn"
) -> DataFrame:
    """Add ``should_intervene``: 1 right before a moderator's comment.

    Missing on the moderator's own comments, which are no candidates.
    """
    labelled = next_value(comments, key, position, "is_moderator", "_next")
    label = (
        F.when(F.col("is_moderator"), F.lit(None).cast("double"))
        .when(F.coalesce("_next", F.lit(False)), 1.0)
        .otherwise(0.0)
    )
    return labelled.withColumn("should_intervene", label).drop("_next")


def intervention_by_reply(
    comments: DataFrame, key: str = "conv_id", message: str = "message_id", parent: str = "reply_to"
) -> DataFrame:
    """Add ``should_intervene`` without turns: 1 on a comment that a moderator's comment replies to.

    Missing on the moderator's own comments, which are no candidates. A reply
    counts in its own discussion only. Answered ids are made distinct before
    anything moves, so a much answered comment is one row.
    """
    answered = (
        comments.where(F.col("is_moderator") & F.col(parent).isNotNull())
        .select(F.col(key).alias("_conv"), F.col(parent).alias("_answered"))
        .distinct()
    )
    same = F.col(key).eqNullSafe(F.col("_conv")) & (F.col(message) == F.col("_answered"))
    label = (
        F.when(F.col("is_moderator"), F.lit(None).cast("double")).when(F.col("_answered").isNotNull(), 1.0).otherwise(0.0)
    )
    return comments.join(answered, same, "left").withColumn("should_intervene", label).drop("_conv", "_answered")
