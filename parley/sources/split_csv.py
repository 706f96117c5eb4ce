"""CSV whose fields hold line breaks, read in many tasks however few files there are.

A file is scanned as lines in byte ranges. Whether a line starts a record depends
on all quotes before it, so a first pass counts the quotes of every range (text
stays where it is) and a running parity over one row per range tells which
ranges begin inside a quoted field. The second pass puts lines together to
records inside each range and parses them there. A record that crosses into other
ranges comes out in fragments, at most two a range, which are joined at the end.

Quotes are doubled inside fields, and only fields in quotes hold quotes, as every
CSV writer does it. Records end with a line feed, with or without a carriage
return. Empty lines between records are skipped. A quote that is never closed
makes the rest of its file one record. All files have the same header; the first
record of each is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parley.session import pinned, work_path

OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
# What a row of the second pass is.
RECORD, HEADER, PIECE = 0, 1, 2
# What a piece does, in the order of a range: closes a record, goes on with one, opens one.
CLOSES, GOES_ON, OPENS = 0, 1, 2
_FOUND = pa.schema([
    ("kind", pa.int32()), ("split", pa.int64()), ("role", pa.int32()), ("heads", pa.bool_()), ("raw", pa.binary()),
])


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines as bytes with their file and byte range, and whether they hold an odd number of quotes."""
    lines = spark.read.options(recursiveFileLookup=True, lineSep="\n").text(path)
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        (quotes % 2 == 1).alias("odd"), F.col("value").cast("binary").alias("value"),
    )


def _splits(lines: DataFrame) -> DataFrame:
    """Per byte range: its number, whether it begins inside a field in quotes, and whether it is its file's first.

    One row per range: as many as the scan's own plan lists.
    """
    counted = lines.groupBy("file", "start").agg(F.sum(F.col("odd").cast("int")).alias("odd"))
    of_file = Window.partitionBy("file").orderBy("start")
    before = F.sum("odd").over(of_file.rowsBetween(Window.unboundedPreceding, -1))
    return counted.select(
        "file", "start", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"),
        (F.row_number().over(of_file) == 1).alias("first"),
        F.row_number().over(Window.orderBy("file", "start")).cast("long").alias("split"),
    )


class _Assembler:
    """Puts the lines of one range after another together to records."""

    def __init__(self) -> None:
        self.split, self.held, self.rows = None, [], []
        self.inside = self.open_head = self.header = False

    def begin(self, split: int, inside: bool, first: bool) -> None:
        self.split, self.held, self.inside = split, [], inside
        self.open_head, self.header = inside, first

    def emit(self, kind: int, role: int) -> None:
        raw = b"\n".join(self.held)
        if kind == PIECE or role or raw.removesuffix(b"\r"):
            self.rows.append((kind, self.split, role, self.header, raw))
        # A line that is empty is no record, and no header either.
        if raw.removesuffix(b"\r") and not self.open_head:
            self.header = False
        self.held, self.open_head = [], False

    def add(self, lines: list[bytes], odd: np.ndarray) -> None:
        after = np.logical_xor.accumulate(odd) ^ self.inside
        at = 0
        for end in np.flatnonzero(~after).tolist():
            self.held += lines[at : end + 1]
            at = end + 1
            if self.open_head:
                self.emit(PIECE, CLOSES)
            else:
                self.emit(HEADER if self.header else RECORD, 0)
        self.held += lines[at:]
        self.inside = bool(after[-1])

    def finish(self) -> None:
        if self.held:
            self.emit(PIECE, GOES_ON if self.open_head else OPENS)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=_FOUND)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = _Assembler()
    for batch in batches:
        if not batch.num_rows:
            continue
        splits = batch.column("split").to_numpy(zero_copy_only=False)
        odd = batch.column("odd").to_numpy(zero_copy_only=False)
        values = batch.column("value").to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(splits)) + 1).tolist(), len(splits)]
        for low, high in zip(cuts, cuts[1:]):
            if splits[low] != state.split:
                state.finish()
                state.begin(int(splits[low]), batch.column("inside")[low].as_py(), batch.column("first")[low].as_py())
            state.add(values[low:high], odd[low:high])
        if state.rows:
            yield state.batch()
    state.finish()
    if state.rows:
        yield state.batch()


def _stitched(pieces: DataFrame) -> DataFrame:
    """Records from their pieces. Which piece belongs to which is decided without the texts."""
    order = Window.orderBy("split", "role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.max(F.when(F.col("role") == OPENS, F.struct("split", "heads"))).over(order)
    owner = pieces.select("split", "role", opened.alias("o")).select("split", "role", "o.split", "o.heads").toDF(
        "split", "role", "record", "header"
    )
    found = pieces.drop("heads").join(owner, ["split", "role"]).groupBy("record", "header").agg(
        F.sort_array(F.collect_list(F.struct("split", "role", F.col("raw").cast("string").alias("text")))).alias("p")
    )
    return found.select("header", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def _fields(text: Column, header: list[str], options: dict) -> Column:
    """The text fields of a record."""
    names = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
    own = {k: str(v) for k, v in options.items() if k not in ("header", "enforceSchema", "recursiveFileLookup")}
    return F.from_csv(F.regexp_replace(text, "\r$", ""), names, {**own, "multiLine": "true"})


def read(
    spark: SparkSession, path: str | list[str], schema: T.StructType, typed, split_bytes: int | None = None, **options
) -> DataFrame:
    """The rows, landed in the shared folder as Parquet; `typed` makes a column of a field of the schema.

    Both passes must see the same byte ranges, so what decides them is held while
    they run. `split_bytes` is the largest range; by default Spark's setting.
    """
    reader = {**OPTIONS, **options}
    header = spark.read.options(**reader, recursiveFileLookup=True).csv(path).columns
    missing = sorted(set(schema.names) - set(header))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    held = {"spark.sql.files.minPartitionNum": str(spark.sparkContext.defaultParallelism)}
    if split_bytes:
        held["spark.sql.files.maxPartitionBytes"] = str(split_bytes)
    folder = work_path(spark, "split-csv")
    with pinned(spark, held):
        lines = _lines(spark, path)
        _splits(lines).write.parquet(f"{folder}/splits")
        # Bounded by the number of byte ranges, which the plan of every scan lists on the driver.
        splits = F.broadcast(spark.read.parquet(f"{folder}/splits"))
        known = lines.join(splits, ["file", "start"], "left").withColumn(
            "split", F.coalesce("split", F.raise_error(F.lit("the byte ranges changed between two scans")).cast("long"))
        )
        rows = known.select("split", "inside", "first", "odd", "value").mapInArrow(
            _assemble, "kind int, split long, role int, heads boolean, raw binary"
        )
        whole = F.when(F.col("kind") == RECORD, F.col("raw").cast("string"))
        columns = _typed_fields(_fields(whole, header, reader), schema, typed)
        kept = F.when(F.col("kind") != RECORD, F.col("raw")).alias("_raw")
        rows.select(columns.alias("_row"), "kind", "split", "role", "heads", kept).write.partitionBy("kind").parquet(
            f"{folder}/rows"
        )
    found = spark.read.schema(
        T.StructType([
            T.StructField("_row", schema), *T._parse_datatype_string("split long, role int, heads boolean, _raw binary, kind int")
        ])
    ).parquet(f"{folder}/rows")
    headers = found.where(F.col("kind") == HEADER).select(F.regexp_replace(F.col("_raw").cast("string"), "^\ufeff|\r$", ""))
    if len(headers.distinct().limit(2).collect()) > 1:
        raise ValueError("files with different headers")
    stitched = _stitched(
        found.where(F.col("kind") == PIECE).select("split", "role", "heads", F.col("_raw").alias("raw"))
    ).where(~F.col("header"))
    own = _typed_fields(_fields(F.col("text"), header, reader), schema, typed)
    return found.where(F.col("kind") == RECORD).select("_row.*").union(stitched.select(own.alias("_row")).select("_row.*"))


def _typed_fields(fields: Column, schema: T.StructType, typed) -> Column:
    return F.struct(*[typed(f, fields[f.name]) for f in schema])
