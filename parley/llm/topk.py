"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of top lists.

Vectors are quantised to integers and packed into shards, the queries into
blocks; one tile is one block against one shard. Tiles are dealt by (block,
shard), so that all executors work on any number of queries. A tile computes
its scores a few hundred queries at a time, keeps the k best of each query, and
the lists are merged sixteen at a time until one per query is left.

Scores are exact: products run in the smallest float type that holds every
partial sum as an integer, else in unbounded integers.

Defined cases: vectors that are null or hold null or non-finite components take
no part; vectors of different lengths are not compared; an empty vector scores
0 with other empty ones. A null id is never a query; as a candidate it is
ranked after all ids of its score. Rows that repeat an id are rows of their own:
each is its own query and a candidate of the others. Fewer candidates than k
give shorter lists. Extra columns are not read. Scores beyond 64 bits are set to
the nearest 64 bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.shared import landed

SCALE = 64
ROWS_PER_SHARD = 4_096
QUERIES_PER_BLOCK = 2_048
QUERIES_AT_ONCE = 256
FAN_IN = 16
NO_ID = (1 << 63) - 1
_LONG = (1 << 63) - 1

_SHARD = "shard long, dim int, n int, ids binary, vectors binary, asked binary"
_BLOCK = "block long, dim int, n int, ids binary, homes binary, places binary, vectors binary"
_TOP = "block long, place int, vec_id long, shard long, top array<struct<s:long,id:long>>"


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for vectors that take no part."""
    usable = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(blob: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(blob, f"<i{len(blob) // (n * dim)}" if n * dim else "<i8").reshape(n, dim)


def _narrow(matrix: np.ndarray) -> bytes:
    """The rows in the smallest integer type that holds them all."""
    top = max(abs(int(matrix.min())), abs(int(matrix.max()) + 1)) if matrix.size else 0
    kind = next(k for k, limit in (("<i1", 1 << 7), ("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 64)) if top <= limit)
    return matrix.astype(kind).tobytes()


def _by_length(batches: Iterator[pa.RecordBatch], column: str, rows: int):
    """Batches regrouped into tables of at most `rows` vectors of one length."""
    held: dict[int, list[pa.Table]] = {}
    for batch in batches:
        whole = pa.Table.from_batches([batch])
        lengths = pc.list_value_length(whole[column]).to_numpy()
        for dim in np.unique(lengths):
            held.setdefault(int(dim), []).append(whole.filter(pa.array(lengths == dim)))
            while sum(map(len, held[int(dim)])) >= rows:
                joined = pa.concat_tables(held[int(dim)])
                yield int(dim), joined.slice(0, rows)
                held[int(dim)] = [joined.slice(rows)]
    for dim, parts in held.items():
        joined = pa.concat_tables(parts)
        if len(joined):
            yield dim, joined


def _values(rows: pa.Table, column: str, dim: int) -> np.ndarray:
    lists = rows[column].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy().reshape(len(rows), dim)


def _number() -> Iterator[int]:
    """Numbers that no other task of the stage gives."""
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def _pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = _number()
    for dim, rows in _by_length(batches, "vector", ROWS_PER_SHARD):
        rows = rows.sort_by("id")
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([next(numbers)], pa.int64()), "dim": pa.array([dim], pa.int32()),
            "n": pa.array([len(rows)], pa.int32()), "ids": [rows["id"].to_numpy().astype("<i8").tobytes()],
            "vectors": [_narrow(_values(rows, "vector", dim))],
            "asked": [rows["asked"].to_numpy().astype(np.uint8).tobytes()],
        })


def _pick_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            at = np.flatnonzero(np.frombuffer(row["asked"], np.uint8))
            vectors = _matrix(row["vectors"], row["n"], row["dim"])[at].astype(np.int64)
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * row["dim"])
            yield pa.RecordBatch.from_pydict({
                "home": pa.array(np.full(len(at), row["shard"])), "place": pa.array(at.astype(np.int32)),
                "id": pa.array(np.frombuffer(row["ids"], "<i8")[at]),
                "vector": pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel())),
            })


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = _number()
    for dim, rows in _by_length(batches, "vector", QUERIES_PER_BLOCK):
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([next(numbers)], pa.int64()), "dim": pa.array([dim], pa.int32()),
            "n": pa.array([len(rows)], pa.int32()), "ids": [rows["id"].to_numpy().astype("<i8").tobytes()],
            "homes": [rows["home"].to_numpy().astype("<i8").tobytes()],
            "places": [rows["place"].to_numpy().astype("<i8").tobytes()],
            "vectors": [_narrow(_values(rows, "vector", dim))],
        })


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of two integer matrices."""
    def most(m: np.ndarray) -> int:
        return max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0

    bound = most(queries) * most(rows) * max(1, queries.shape[1])
    for kind, limit in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if bound <= limit:
            return (queries.astype(kind) @ rows.astype(kind).T).astype(np.int64)
    exact = queries.astype(object) @ rows.astype(object).T
    return np.clip(exact, -_LONG, _LONG).astype(np.int64)


def tile_top(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of each row's k best scores, best first, and whether each counts; ties to the smaller column.

    own: the column that is the query itself, -1 if it lies elsewhere.
    """
    n, width = scores.shape
    k = min(k, width)
    bits = max(1, (width - 1).bit_length())
    if abs(scores).max(initial=0) < 1 << (62 - bits):
        # Score and column in one number: partial selection then breaks ties by itself.
        keys = (scores << bits) + ((1 << bits) - 1 - np.arange(width))
        mine = np.flatnonzero(own >= 0)
        keys[mine, own[mine]] = -_LONG
        best = np.sort(np.partition(keys, width - k, axis=1)[:, width - k :], axis=1)[:, ::-1]
        return (1 << bits) - 1 - (best & ((1 << bits) - 1)), best > -_LONG
    columns = np.empty((n, k), np.int64)
    counts = np.ones((n, k), bool)
    for i in range(n):
        order = [j for j in np.argsort(-scores[i].astype(object), kind="stable") if j != own[i]][:k]
        columns[i, : len(order)] = order
        counts[i, len(order) :] = False
    columns[~counts] = 0
    return columns, counts


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                yield from _tile(row, k)

    return run


def _tile(row: dict, k: int) -> Iterator[pa.RecordBatch]:
    queries = _matrix(row["vectors"], row["n"], row["dim"])
    rows = _matrix(row["shard_vectors"], row["shard_n"], row["dim"])
    ids = np.frombuffer(row["shard_ids"], "<i8")
    query_ids = np.frombuffer(row["ids"], "<i8")
    here = np.frombuffer(row["homes"], "<i8") == row["shard"]
    own = np.where(here, np.frombuffer(row["places"], "<i8"), -1)
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        some = slice(at, at + QUERIES_AT_ONCE)
        scores = exact_scores(queries[some], rows)
        columns, counts = tile_top(scores, own[some], k)
        found = np.take_along_axis(scores, np.where(counts, columns, 0), axis=1)
        offsets = np.concatenate([[0], np.cumsum(counts.sum(axis=1))]).astype(np.int32)
        lists = pa.StructArray.from_arrays(
            [pa.array(-found[counts]), pa.array(ids[columns[counts]])], ["s", "id"]
        )
        n = len(columns)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(np.full(n, row["block"])),
            "place": pa.array(np.arange(at, at + n, dtype=np.int32)),
            "vec_id": pa.array(query_ids[some]),
            "shard": pa.array(np.full(n, row["number"])),
            "top": pa.ListArray.from_arrays(pa.array(offsets), lists),
        })


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Dense numbers for packed rows, thousands of vectors each."""
    numbers = df.select(name, (F.row_number().over(Window.orderBy(name)) - 1).cast("long").alias("number"))
    return df.join(numbers, name)


def _best(k: int) -> Column:
    return F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top")


def search(
    vectors: DataFrame, is_query: Column, *, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """Top k of every query row: query_id, rank (from 1), the candidate's id and the score.

    is_query: a condition on the columns of `vectors`; null counts as false.
    """
    rows = vectors.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"),
        (F.coalesce(is_query, F.lit(False)) & F.col(key).isNotNull()).alias("asked"),
        quantised(F.col(vector), scale).alias("vector"),
    ).where(F.col("vector").isNotNull())
    shards = landed(rows.mapInArrow(_pack_shards, _SHARD), "topk-shards")
    picked = shards.mapInArrow(_pick_queries, "home long, place int, id long, vector array<long>")
    picked = landed(picked, "topk-queries")
    n_blocks = max(1, -(-picked.count() // QUERIES_PER_BLOCK))
    blocks = picked.repartition(n_blocks, "home", "place").mapInArrow(_pack_queries, _BLOCK)
    blocks = _numbered(landed(blocks, "topk-blocks"), "block")
    n_blocks, n_shards = max(1, blocks.count()), max(1, shards.count())
    right = _numbered(shards, "shard").select(
        "shard", "number", "dim", F.col("n").alias("shard_n"), F.col("ids").alias("shard_ids"),
        F.col("vectors").alias("shard_vectors"), F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")).alias("to_block"),
    )
    left = blocks.select(
        "block", "dim", "n", "ids", "homes", "places", "vectors", F.col("number").alias("from_block"),
        F.explode(F.expr(f"sequence(0L, {n_shards - 1}L)")).alias("to_shard"),
    )
    same = (F.col("from_block") == F.col("to_block")) & (F.col("to_shard") == F.col("number"))
    tiles = left.join(right, same & (left["dim"] == right["dim"])).drop(right["dim"])
    tops = tiles.repartition(n_blocks * n_shards, "block", "shard").mapInArrow(_tiles(k), _TOP)
    while n_shards > 1:
        tops = tops.groupBy("block", "place", "vec_id", F.floor(F.col("shard") / FAN_IN).alias("shard")).agg(_best(k))
        n_shards = -(-n_shards // FAN_IN)
    return tops.select(F.col("vec_id").alias("query_id"), F.posexplode("top").alias("rank", "t")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"),
        F.nullif("t.id", F.lit(NO_ID)).alias(key), (-F.col("t.s")).alias("score"),
    )
