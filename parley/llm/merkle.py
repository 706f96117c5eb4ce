"""Merkle manifest of a data set: a tree of row digests per group, and a recursive climb that proves rows.

A leaf is the SHA-256 of a row's fields, each written as `-` if null, else as its
number of UTF-8 bytes, `:` and its value. Leaves of a group ascend by id; three
consecutive nodes become one (a last run may be shorter, even a single node)
until one is left, the group's subroot. Subroots, in the order of the groups
(null first, then by bytes), become the root in the same way. Digests enter a
hash as lowercase hex text; tables hold them as bytes.

Built levels are stored as node rows: a row holds the digests of up to 27 nodes
and of the levels above them up to their common ancestor, three levels in all,
with a link to its parent row and its place there. A recursive query of Spark
climbs them from every leaf: a step joins the parent row, appends the siblings
of its levels, and folds the leaf's hash, which may be tampered with, through
them. Three levels a step keep what the recursion shuffles small.

Both sides of that join carry a chunk of 729 consecutive leaves, rows near the
root one copy per chunk below them, so no step gathers a large group: no join key
has more than 729 leaves. Order comes from range partitions of (group, id)
and counts per partition. Only heights and sums per partition reach the driver.

Defined cases: a null id comes first in its group; rows of one id are in the
order of their digests, equal rows in any. Null and missing fields are `-`. A
lone leaf is its subroot, a lone subroot the root; without siblings the
proof is the hash of nothing. An empty table has no nodes and gives no rows.
Extra columns are not read. Texts are read whole, once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.shared import landed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Children of a node, and the levels of a node row.
FAN_OUT, LEVELS = 3, 3
NODES = FAN_OUT**LEVELS
# Leaves of a chunk: two node rows deep.
CHUNK = NODES**2
# Rows of a range partition, and copies of a node row that one task makes.
ROWS_PER_RANGE, COPIES = 65_536, 1_024
DIGEST_BYTES = 32
# Names of node rows in a chunk: 0 to 26 its first rows, then the steps above, then those over groups.
_UPPER, _OVER = 100, 1_000
# Rows a recursion may return; Spark's own default is a million.
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

CLIMB = """
with recursive climb (chunk, leaf, node, place, step, hash, siblings) as (
  select chunk, leaf, node, place, 0, hash, cast('' as binary) from {leaves}
  union all
  select chunk, leaf, parent, parent_place, step + 1, up.hash, up.siblings
  from (
    select c.chunk, c.leaf, n.parent, n.parent_place, c.step,
      aggregate(n.levels, named_struct('hash', c.hash, 'place', c.place, 'siblings', cast('' as binary)),
        (s, level) -> named_struct(
          'hash', unhex(sha2(lower(hex(concat(
            substring(level, 96 * int(s.place div 3) + 1, 32 * int(s.place % 3)), s.hash,
            substring(level, 96 * int(s.place div 3) + 32 * int(s.place % 3) + 33, 64 - 32 * int(s.place % 3))))), 256)),
          'place', s.place div 3,
          'siblings', concat(s.siblings,
            substring(level, 96 * int(s.place div 3) + 1, 32 * int(s.place % 3)),
            substring(level, 96 * int(s.place div 3) + 32 * int(s.place % 3) + 33, 64 - 32 * int(s.place % 3))))
      ) as up
    from climb c join {nodes} n on c.chunk = n.chunk and c.node = n.node
  )
)
select chunk, leaf, step, hash, siblings from climb
"""


@dataclass(frozen=True)
class Manifest:
    """A built tree: a row per leaf, the node rows of every chunk, and the subroot and root of every chunk."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame


def hashed(text: Column) -> Column:
    """SHA-256 of a string or of bytes, as bytes."""
    return F.unhex(F.sha2(text, 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row, as bytes."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-"))
             for f in fields]
    return hashed(F.concat(*parts))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parents(level: Column) -> Column:
    """The digests above a level, both as the bytes of all digests in order."""
    run = FAN_OUT * DIGEST_BYTES
    starts = F.sequence(F.lit(1), F.octet_length(level), F.lit(run))
    return F.unhex(F.array_join(F.transform(starts, lambda i: F.sha2(hex_text(F.substring(level, i, F.lit(run))), 256)), ""))


def _height(n: Column) -> Column:
    """Levels above n nodes until one is left."""
    powers = F.array(*[F.lit(FAN_OUT**i).cast("long") for i in range(40)])
    return F.size(F.filter(powers, lambda p: p < n))


def _built(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node rows over nodes (tree, height, idx, hash), and the top of each tree.

    Node rows: tree, step, block, levels. Step k covers 27 nodes of level 3k; a
    row goes through as many levels as its tree still has, three at most.
    """
    spark = nodes.sparkSession
    rows, tops = [], [nodes.where("height = 0").select("tree", F.col("hash").alias("top"))]
    steps = -(-(nodes.agg(F.max("height")).first()[0] or 0) // LEVELS)
    live = nodes.where("height > 0").select("tree", "height", "idx", "hash")
    for step in range(steps):
        grouped = live.groupBy("tree", "height", F.floor(F.col("idx") / NODES).alias("block")).agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("idx", "hash"))), lambda x: F.hex(x["hash"])), ""
            ).alias("packed")
        )
        here = F.sequence(F.lit(1), F.least(F.lit(LEVELS), F.col("height") - LEVELS * step))
        levels = F.aggregate(
            here, F.array(F.unhex("packed")),
            lambda made, _: F.concat(made, F.array(_parents(F.element_at(made, -1)))),
        )
        made = _let(levels, lambda x: F.struct(F.slice(x, 1, F.size(x) - 1).alias("levels"), F.element_at(x, -1).alias("top")))
        out = landed(
            grouped.select("tree", "height", F.lit(step).alias("step"), "block", made.alias("m")).select(
                "tree", "height", "step", "block", "m.levels", "m.top"
            ),
            "merkle-nodes",
        )
        rows.append(out.select("tree", "height", "step", "block", "levels"))
        done = F.col("height") <= LEVELS * (step + 1)
        tops.append(out.where(done).select("tree", "top"))
        live = out.where(~done).select("tree", "height", F.col("block").alias("idx"), F.col("top").alias("hash"))
    if not rows:
        schema = "tree long, height int, step int, block long, levels array<binary>"
        rows = [spark.createDataFrame([], schema)]
    return _all(rows), _all(tops)


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows (grp, id, hash, ..) with `part` and `seq`: their range partition in that order, and the place in it."""
    parts = max(1, -(-rows.count() // ROWS_PER_RANGE))
    order = ["grp", F.col("id").asc_nulls_first(), "hash", "tie"]
    placed = (
        rows.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(max(parts, rows.sparkSession.sparkContext.defaultParallelism), *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("part", F.shiftright("at", 33)).withColumn("seq", F.col("at").bitwiseAND((1 << 33) - 1))
    return landed(placed.drop("tie", "at"), "merkle-leaves")


def _groups(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces (part, grp, first_seq, before): what a partition holds of a group and the rows of the group before it;
    groups (grp, rank, n, first_chunk): in order, with their rows, and the chunks of all groups before them."""
    pieces = landed(
        ordered.groupBy("part", "grp").agg(F.count("*").alias("rows"), F.min("seq").alias("first_seq")), "merkle-pieces"
    )
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0))
    groups = pieces.groupBy("grp").agg(F.sum("rows").alias("n"), F.min("part").alias("part"))
    groups = groups.withColumn("chunks", F.ceil(F.col("n") / CHUNK))
    # A running sum over partitions, then over the groups that begin in one.
    sums = groups.groupBy("part").agg(F.count("*").alias("of_groups"), F.sum("chunks").alias("of_chunks"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "part", F.coalesce(F.sum("of_groups").over(upto), F.lit(0)).alias("rank_before"),
        F.coalesce(F.sum("of_chunks").over(upto), F.lit(0)).alias("chunk_before"),
    )
    inside = Window.partitionBy("part").orderBy("grp")
    groups = groups.join(sums, "part").select(
        "grp", "n",
        (F.col("rank_before") + F.row_number().over(inside) - 1).alias("rank"),
        (F.col("chunk_before") + F.sum("chunks").over(inside) - F.col("chunks")).alias("first_chunk"),
        "chunks",
    )
    return pieces.withColumn("before", before).drop("rows"), landed(groups, "merkle-groups")


def _spread(rows: DataFrame) -> DataFrame:
    """A copy of every row for each `chunk` from `low` to `high`; a row with many copies is spread first."""
    cuts = F.sequence(F.col("low"), F.col("high"), F.lit(COPIES).cast("long"))
    pieces = rows.select("*", F.explode(cuts).alias("from")).repartition("from", "low", "high")
    own = F.sequence(F.col("from"), F.least(F.col("high"), F.col("from") + COPIES - 1))
    return pieces.select(F.explode(own).alias("chunk"), *(c for c in rows.columns if c not in ("low", "high")))


def build(
    docs: DataFrame, *, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS,
    tampered: dict[str, Column] | None = None, tampered_where: Column | None = None,
) -> Manifest:
    """The tree over the rows. `tampered` replaces fields where `tampered_where` holds: the hash a row climbs with."""
    own = [F.col(f) for f in fields]
    leaf = leaf_digest(own)
    changed = leaf_digest([(tampered or {}).get(f, F.col(f)) for f in fields])
    other = F.when(F.coalesce(tampered_where, F.lit(False)), changed) if tampered else F.lit(None).cast("binary")
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    ordered = _ordered(docs.select(grp.alias("grp"), F.col(key).alias("id"), leaf.alias("hash"), other.alias("other")))
    pieces, groups = _groups(ordered)
    # Rows meet what is known of their group by (partition, group): a partition has a bounded number of rows.
    known = pieces.join(groups.drop("chunks"), "grp")
    leaves = ordered.join(known, ["part", "grp"]).select(
        "id", F.col("rank").alias("tree"), _height(F.col("n")).alias("height"),
        (F.col("seq") - F.col("first_seq") + F.col("before")).alias("idx"), "first_chunk", "hash", "other",
    )
    leaves = landed(leaves, "merkle-numbered")
    blocks, subroots = _built(leaves)
    subroots = landed(subroots, "merkle-subroots")
    count = subroots.count()
    over, roots = _built(
        subroots.select(F.lit(0).cast("long").alias("tree"), _height(F.lit(count)).alias("height"),
                        F.col("tree").alias("idx"), F.col("top").alias("hash"))
    )
    has_over = F.lit(count > 1)
    first_over = F.when(has_over, F.lit(_OVER).cast("long"))
    # Links and chunks of the node rows of groups.
    steps = F.ceil(F.col("height") / LEVELS)
    last = F.col("step") + 1 >= steps
    span = F.pow(F.lit(float(NODES)), F.col("step") - 1).cast("long")
    first_step = F.col("step") == 0
    low = F.when(first_step, F.floor(F.col("block") / NODES)).otherwise(F.col("block") * span)
    high = F.when(first_step, low).otherwise(F.least(low + span, F.col("chunks")) - 1)
    tree = groups.select(F.col("rank").alias("tree"), "first_chunk", "chunks")
    lower = blocks.join(tree, "tree").select(
        (F.col("first_chunk") + low).alias("low"), (F.col("first_chunk") + high).alias("high"),
        F.when(first_step, F.col("block") % NODES).otherwise(F.col("step") + _UPPER).cast("long").alias("node"),
        F.when(~last, F.col("step") + _UPPER + 1).otherwise(first_over).cast("long").alias("parent"),
        F.when(~last, F.col("block") % NODES).otherwise(F.col("tree") % NODES).cast("long").alias("parent_place"),
        "levels",
    )
    # Those over groups reach from the first chunk of their first group to the last of their last one.
    width = F.pow(F.lit(float(NODES)), F.col("step") + 1).cast("long")
    ranges = over.withColumn("from_rank", F.col("block") * width).withColumn(
        "to_rank", F.least(F.col("from_rank") + width, F.lit(count)) - 1
    )
    starts = groups.select(F.col("rank").alias("from_rank"), F.col("first_chunk").alias("low"))
    ends = groups.select(F.col("rank").alias("to_rank"), (F.col("first_chunk") + F.col("chunks") - 1).alias("high"))
    top_step = F.col("step") + 1 >= F.ceil(F.col("height") / LEVELS)
    upper = ranges.join(starts, "from_rank").join(ends, "to_rank").select(
        "low", "high", (F.col("step") + _OVER).cast("long").alias("node"),
        F.when(~top_step, F.col("step") + _OVER + 1).cast("long").alias("parent"),
        F.when(~top_step, F.col("block") % NODES).cast("long").alias("parent_place"), "levels",
    )
    nodes = landed(_spread(lower.union(upper)), "merkle-tree")
    single = F.col("height") == 0
    leaves = leaves.select(
        "id", (F.col("first_chunk") + F.floor(F.col("idx") / CHUNK)).alias("chunk"), (F.col("idx") % CHUNK).alias("leaf"),
        F.when(single, first_over).otherwise(F.floor(F.col("idx") % CHUNK / NODES)).cast("long").alias("node"),
        F.when(single, F.col("tree") % NODES).otherwise(F.col("idx") % NODES).cast("long").alias("place"),
        "hash", F.coalesce("other", "hash").alias("climbs"),
    )
    whole = roots.select(F.col("top").alias("root"), F.lit(0).cast("long").alias("tree"))
    tops = tree.join(subroots, "tree").select(
        F.col("first_chunk").alias("low"), (F.col("first_chunk") + F.col("chunks") - 1).alias("high"),
        F.col("top").alias("subroot"), F.lit(0).cast("long").alias("tree"),
    )
    # The root is one row.
    return Manifest(leaves, nodes, landed(_spread(tops.join(F.broadcast(whole), "tree").drop("tree")), "merkle-roots"))


def climbed(manifest: Manifest) -> DataFrame:
    """Per leaf (chunk, leaf): `folded`, the hash it reaches at the root, and `proof`, all siblings in order.

    The recursion's row limit is lifted while it is written, and put back.
    """
    spark = manifest.leaves.sparkSession
    start = manifest.leaves.select("chunk", "leaf", "node", "place", F.col("climbs").alias("hash"))
    before = spark.conf.get(_ROW_LIMIT, None)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        steps = spark.sql(CLIMB, leaves=start, nodes=manifest.nodes)
        found = steps.groupBy("chunk", "leaf").agg(
            F.max_by("hash", "step").alias("folded"),
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("step", "siblings"))), lambda x: hex_text(x["siblings"])), ""
            ).alias("proof"),
        )
        return landed(found.select("chunk", "leaf", "folded", hashed(F.col("proof")).alias("proof")), "merkle-climbed")
    finally:
        if before is None:
            spark.conf.unset(_ROW_LIMIT)
        else:
            spark.conf.set(_ROW_LIMIT, before)


def verified(manifest: Manifest) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root (hex) and whether that is the root."""
    rows = manifest.leaves.join(climbed(manifest), ["chunk", "leaf"]).join(manifest.roots, "chunk")
    return rows.select(
        "id", hex_text(F.col("hash")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"),
        hex_text(F.col("root")).alias("root"), hex_text(F.col("proof")).alias("proof_sha256"),
        hex_text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
