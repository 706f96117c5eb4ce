"""Token ids in binary shards, with a minimal perfect hash index from keys to shard rows.

Files below one folder of the shared store:

- `shard-<number>-<attempt>.ids`: the ids of the shard's documents, end to end,
  little endian, 2 bytes an id if the vocabulary allows, else 4. Shards and the
  documents in them are in ascending order of the key.
- `shard-<number>-<attempt>.ptr`: unsigned 64 bit numbers, the id offset of each
  document in the shard and the total.
- `index-<bucket>-<attempt>.mph`: for the keys of one hash bucket, the levels of
  the hash and, by slot, a 32 bit fingerprint of the key, shard, first row in
  the shard, and number of rows.
- `manifest` and `index` (Parquet): which attempt's file counts. Spark commits
  them, so files that a lost or repeated task left behind are never read.

A keyed access reads one bucket's index (cached), two offsets and the ids.

Defined cases: a null or empty text has only the end id; a null key is a key of
its own, before all others; repeated keys share an entry and are returned each,
in the order of their ids' hash, so a key's rows are adjacent and in one shard.
Unknown keys return no row. An empty table gives no shard. Extra columns are
not read. Ids of the documents (keys) are integers of up to 64 bits.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm import files, perfect_hash
from parley.llm.shared import id_slicer
from parley.llm.vocabulary import ChunkEncoder, texts_of

ROWS_PER_SHARD = 8_192
KEYS_PER_BUCKET = 65_536
# Partitions per shard, so that few shards share one.
SPREAD = 3
# Rows of a batch that leave Python at once.
ROWS_OUT = 512
# Stands for a null key inside the index; a key of this very value counts as null.
NULL_KEY = -(1 << 63)


@dataclass(frozen=True)
class TokenFiles:
    """A written folder: where it is, bytes of an id, shards, buckets of the index, and the tables."""

    folder: str
    id_bytes: int
    shards: int
    buckets: int
    manifest: DataFrame
    index: DataFrame


@functools.lru_cache(4)
def _library_encoder(path: str, id_bytes: int) -> ChunkEncoder:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    tokenize, written = library.model.tokenize, [i.to_bytes(id_bytes, "little") for i in range(library.get_vocab_size())]
    return ChunkEncoder(path, lambda piece: b"".join([written[t.id] for t in tokenize(piece)]), id_bytes)


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def library_ids(text: Column, path: str, end_id: int, id_bytes: int) -> Column:
    """Ids of whole texts by the tokenizers library, with the end id, as binary."""
    end = end_id.to_bytes(id_bytes, "little")

    @F.arrow_udf("binary")
    def library_encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _library_encoder(path, id_bytes)
        for batch in batches:
            for some in batched(encoder.encode_all(texts_of(batch)), ROWS_OUT):
                yield pa.array([ids + end for ids in some], pa.binary())

    return library_encode(text)


class _Shard:
    """One shard being written: ids go out as they come, offsets at the end."""

    def __init__(self, folder: str, number: int, id_bytes: int):
        self.number, self.id_bytes = number, id_bytes
        self.name = f"shard-{number}-{uuid.uuid4().hex}"
        self.path = f"{folder}/{self.name}"
        self.stream, self.offsets = files.write_stream(f"{self.path}.ids"), [0]

    def add(self, ids: bytes) -> None:
        self.stream.write(ids)
        self.offsets.append(self.offsets[-1] + len(ids) // self.id_bytes)

    def close(self) -> None:
        self.stream.close()
        with files.write_stream(f"{self.path}.ptr") as out:
            out.write(np.array(self.offsets, "<u8").tobytes())


def _write_shards(folder: str, id_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for batch in batches:
            rows = []
            for number, key, ids in zip(batch["shard"], batch["key"], batch["ids"], strict=True):
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.close()
                    shard = _Shard(folder, int(number), id_bytes)
                rows.append((number, shard.name, key, len(shard.offsets) - 1, len(ids) // id_bytes))
                shard.add(ids)
            yield pd.DataFrame(rows, columns=["shard", "file", "key", "row", "n"])
        if shard is not None:
            shard.close()

    return run


def write(
    docs: DataFrame,
    folder: str,
    path: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    rows_per_shard: int = ROWS_PER_SHARD,
    keys_per_bucket: int = KEYS_PER_BUCKET,
) -> TokenFiles:
    """Encode the texts, write shards and index below `folder`, and return the written files.

    Only ids move: texts are encoded where they are scanned. Shards are slices
    of the key range, each sorted and streamed to its file by one task.
    """
    spark, id_bytes = docs.sparkSession, id_width(path)
    files.make_folder(folder)
    own = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"),
        F.col(text).cast("string").alias("text"),
    )
    slice_of, shards = id_slicer(docs.select(F.col(key).cast("long").alias("key")), "key", rows_per_shard)
    rows = own.select(
        (slice_of(F.nullif("key", F.lit(NULL_KEY))) + 1).alias("shard"),
        "key",
        library_ids(F.col("text"), path, end_id, id_bytes).alias("ids"),
    )
    placed = (
        rows.repartition(SPREAD * (shards + 1), "shard")
        .sortWithinPartitions("shard", "key", F.xxhash64("ids"), "ids")
        .mapInPandas(
            _write_shards(folder, id_bytes),
            "shard long, file string, key long, row long, n long",
        )
    )
    placed.write.parquet(f"{folder}/rows")
    placed = spark.read.parquet(f"{folder}/rows")
    manifest = _manifest(placed, folder)
    index, buckets = _build_index(placed, folder, keys_per_bucket)
    return TokenFiles(folder, id_bytes, shards, buckets, manifest, index)


def _manifest(placed: DataFrame, folder: str) -> DataFrame:
    """Each shard with its file, rows, ids, and the ids and rows of all shards before it.

    The running sums go over one row per shard, not over documents.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = placed.groupBy("shard", "file").agg(F.count("*").alias("rows"), F.sum("n").alias("n_ids"))
    out = shards.select(
        "*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_row"),
    )
    out.write.parquet(f"{folder}/manifest")
    return placed.sparkSession.read.parquet(f"{folder}/manifest")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")


def _write_index(folder: str):
    def run(names: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["key"].to_numpy(np.int64).view(np.uint64)
        levels = perfect_hash.build(keys)
        order = np.argsort(perfect_hash.slots(levels, keys))
        columns = {
            "fingerprint": perfect_hash.fingerprints(keys)[order],
            "shard": rows["shard"].to_numpy("<i8")[order],
            "row": rows["row"].to_numpy("<i8")[order],
            "rows": rows["rows"].to_numpy("<i8")[order],
        }
        name = f"index-{int(names[0])}-{uuid.uuid4().hex}.mph"
        with files.write_stream(f"{folder}/{name}") as out:
            out.write(perfect_hash.pack(levels, columns))
        return pd.DataFrame({"bucket": [names[0]], "index_file": [name], "keys": [len(keys)]})

    return run


def _build_index(placed: DataFrame, folder: str, keys_per_bucket: int) -> tuple[DataFrame, int]:
    """Distinct keys by hash bucket; a bucket has about `keys_per_bucket` keys, so a task is bounded."""
    spark = placed.sparkSession
    n = placed.agg(F.approx_count_distinct("key")).first()[0]
    buckets = max(1, -(-n // keys_per_bucket))
    keys = placed.groupBy("key").agg(
        F.min("shard").alias("shard"), F.min("row").alias("row"), F.count("*").alias("rows")
    )
    (
        keys.withColumn("bucket", _bucket(buckets))
        .groupBy("bucket")
        .applyInPandas(_write_index(folder), "bucket long, index_file string, keys long")
        .withColumn("buckets", F.lit(buckets).cast("long"))
        .write.parquet(f"{folder}/index")
    )
    return spark.read.parquet(f"{folder}/index"), buckets


def _probe(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, levels, columns = None, [], {}
        for batch in batches:
            out = []
            for file, part in batch.groupby("index_file", sort=False):
                if file != name:
                    name = file
                    levels, columns = perfect_hash.unpack(files.read_all(f"{folder}/{file}"))
                keys = part["key"].to_numpy(np.int64).view(np.uint64)
                at = perfect_hash.slots(levels, keys)
                known = at >= 0
                known[known] = (
                    columns["fingerprint"][at[known]] == perfect_hash.fingerprints(keys[known])
                )
                found = {c: columns[c][at[known]] for c in ("shard", "row", "rows")}
                out.append(pd.DataFrame({"key": part["key"].to_numpy()[known], **found}))
            if out:
                yield pd.concat(out)

    return run


def lookup(written: TokenFiles, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Shard, first row and number of rows of each distinct known key, through the index."""
    wanted = keys.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key")
    ).distinct()
    return (
        wanted.withColumn("bucket", _bucket(written.buckets))
        .join(written.index.select("bucket", "index_file"), "bucket")
        .repartition(written.buckets, "bucket")
        .sortWithinPartitions("bucket")
        .select("index_file", "key")
        .mapInPandas(_probe(written.folder), "key long, shard long, row long, rows long")
    )


def _read_rows(folder: str, id_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, payload, offsets = None, None, None
        for batch in batches:
            out = []
            for file, key, row, rows, start in batch.itertuples(index=False):
                if file != name:
                    if payload is not None:
                        payload.close()
                    name, payload = file, files.read_file(f"{folder}/{file}.ids")
                    offsets = np.frombuffer(files.read_all(f"{folder}/{file}.ptr"), "<u8")
                for r in range(row, row + rows):
                    first, end = int(offsets[r]), int(offsets[r + 1])
                    payload.seek(first * id_bytes)
                    raw = payload.read((end - first) * id_bytes)
                    ids = np.frombuffer(raw, f"<u{id_bytes}").astype("<u4").tobytes()
                    out.append((key, start + first, end - first, ids))
                    if len(out) >= 2_000:
                        yield pd.DataFrame(out, columns=["key", "start", "n_tokens", "ids"])
                        out = []
            if out:
                yield pd.DataFrame(out, columns=["key", "start", "n_tokens", "ids"])
        if payload is not None:
            payload.close()

    return run


def read(written: TokenFiles, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document of the keys: key, start, n_tokens, and ids as 32 bit little endian binary."""
    found = lookup(written, keys, key)
    shards = written.manifest.select("shard", "file", "start")
    return (
        found.join(shards, "shard")
        .repartition(SPREAD * written.shards, "shard")
        .sortWithinPartitions("shard", "row")
        .select("file", "key", "row", "rows", "start")
        .mapInPandas(
            _read_rows(written.folder, written.id_bytes),
            "key long, start long, n_tokens long, ids binary",
        )
        .withColumn("key", F.nullif("key", F.lit(NULL_KEY)))
        .withColumnRenamed("key", key)
    )


def open_files(spark: SparkSession, folder: str, path: str) -> TokenFiles:
    """A folder written before, for keyed access."""
    manifest, index = (spark.read.parquet(f"{folder}/{name}") for name in ("manifest", "index"))
    buckets = index.agg(F.max("buckets")).first()[0] or 1
    return TokenFiles(folder, id_width(path), max(1, manifest.count()), buckets, manifest, index)
