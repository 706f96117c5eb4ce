"""Length-bucketed batches for padding-free scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.hashing import hash_order
from parley.operators.ordering import global_rank


def length_batches(
    df: DataFrame,
    length: str = "est_length",
    id_col: str = "message_id",
    batch_size: int = 64,
    drop_last: bool = False,
    seed: int = 42,
    epoch: int = 0,
) -> DataFrame:
    """Add ``batch_id`` (runs of equal length order) and ``batch_order`` (shuffled).

    The order inside a length is free, so it is the hash order; that lets one
    very common length be ranked in many tasks. A new epoch changes only the
    order of the batches. Batch ids are consecutive, so their shuffled order
    needs the number of rows and not the rows. ``df`` is read a few times:
    pass ids and lengths from a written table.
    """
    n_rows = df.count()
    n_batches = n_rows // batch_size if drop_last else -(-n_rows // batch_size)
    digest = hash_order(seed, F.col(id_col))
    ranked = global_rank(df.withColumn("_digest", digest), "_digest", id_col, "_rank", major=length)
    batched = ranked.withColumn(
        "batch_id", F.floor((F.col("_rank") - 1) / F.lit(batch_size)).cast("long")
    ).drop("_digest", "_rank")
    shuffled = (
        df.sparkSession.range(n_batches)
        .withColumnRenamed("id", "batch_id")
        .withColumn("_digest", hash_order(seed, F.lit(str(epoch)), F.col("batch_id")))
    )
    order = global_rank(shuffled, "_digest", "batch_id", "batch_order")
    return batched.join(order.select("batch_id", "batch_order"), "batch_id")
