"""Scans. Every group of files is one scan; names become columns.

A "file" may be a plain file or a directory of part files with that name, and
the directory may carry a partition prefix (``export=<name>``): that is how a
cluster writes a large table.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.parsing import parse_dual, parse_single, rating_prefix
from parley.operators.ordering import keep_first
from parley.schemas import COMMENT, CONVERSATION_LOOKUP, SCALES
from parley.sources import split_csv

# Quotes are doubled inside fields and fields may hold line breaks.
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}

RESPONSES = T.StructType(
    [T.StructField("conv_id", T.StringType()), T.StructField("response", T.StringType())]
)
PREDICTIONS = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("is_moderator", T.BooleanType()),
        T.StructField("should_intervene", T.DoubleType()),
        T.StructField("response", T.StringType()),
    ]
)
HUMAN_SHEET = T.StructType(
    [T.StructField("conv_id", T.StringType()), T.StructField("discussion", T.StringType())]
    + [T.StructField("data_malformation", T.StringType())]
    + [T.StructField("rationale/comments", T.StringType())]
    + [T.StructField(s, T.StringType()) for s in SCALES]
)
CURVE = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("Threshold", "Precision", "Recall", "F1")]
)


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, **options
) -> DataFrame:
    """CSV by column name, typed, with the file metadata.

    The header of the first file decides the positions; a file with another
    header raises instead of being read by position. Missing columns raise
    while the query is planned. Spark cannot compare headers with a nameless
    index column; such files are grouped by their own header lines, and each
    group is read by its names.
    """
    reader = {**CSV_OPTIONS, "recursiveFileLookup": True, **options}
    header = spark.read.options(**reader).csv(path).columns
    if not any(re.fullmatch(r"_c\d+", c) for c in header):
        return _read_group(spark, path, header, schema, reader, enforce=False)
    groups = _by_header(spark, path, reader)
    parts = [_read_group(spark, files, names, schema, reader, enforce=True) for names, files in groups]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _by_header(spark: SparkSession, path: str | list[str], reader: dict) -> list[tuple[list[str], list[str]]]:
    """Column names and files of each kind of header line, in one job over first lines."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header")
    out = []
    for row in found.collect():
        cells = next(csv.reader([row["header"]], delimiter=reader.get("sep", ",")))
        out.append(([c or f"_c{i}" for i, c in enumerate(cells)], row["files"]))
    return out


def _read_group(
    spark: SparkSession, path: str | list[str], header: list[str], schema: T.StructType, reader: dict,
    enforce: bool,
) -> DataFrame:
    missing = sorted(set(schema.names) - set(header))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.options(**reader, enforceSchema=enforce).schema(text).csv(path)
    return raw.select(*[_typed(field) for field in schema], "_metadata")


def _typed(field: T.StructField, cell: Column | None = None) -> Column:
    cell = F.col(f"`{field.name}`") if cell is None else cell
    if isinstance(field.dataType, T.BooleanType):
        # True / False or 1.0 / 0.0.
        return F.coalesce(cell.try_cast("boolean"), cell.cast("double") != 0).alias(field.name)
    return cell.cast(field.dataType).alias(field.name)


def read_corpus(
    spark: SparkSession, path: str, schema: T.StructType = COMMENT, split_bytes: int | None = None
) -> DataFrame:
    """The comment corpus from CSV, in as many tasks as its bytes ask for, whatever the number of files.

    Fields may hold line breaks (see `split_csv`). The rows are parsed once and
    landed below the shared folder; ``land_corpus`` copies them to a place of one's own.
    """
    return split_csv.read(spark, path, schema, _typed, split_bytes)


def read_split(
    spark: SparkSession, path: str, split: str, datasets: Sequence[str] | None = None
) -> DataFrame:
    """One split of the landed splits: other partitions are not read."""
    rows = spark.read.parquet(path).where(F.col("split") == split)
    return rows.where(F.col("dataset").isin(*datasets)) if datasets else rows


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Item texts with their dataset, first row per item; tab separated if so named."""
    sep = "\t" if path.lower().endswith(".tsv") else ","
    rows = read_csv(spark, path, CONVERSATION_LOOKUP, sep=sep)
    order = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("_row")]
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    return keep_first(numbered, ["conv_id"], order).drop("_metadata", "_row")


def _named(stem: str) -> str:
    """Pattern for a file or directory name in a path, capturing ``stem``."""
    return rf"/(?:[^/=]+=)?{stem}(?:/[^/]+)?$"


def _from_path(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def _model_name(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1000)))


def _scan(spark: SparkSession, root: str, pattern: str, schema: T.StructType, **options) -> DataFrame:
    """All files below root whose path matches, as one scan.

    Only file names are listed first, as any scan does.
    """
    listed = spark.read.option("recursiveFileLookup", True).text(root).inputFiles()
    files = [f for f in listed if re.search(pattern, f)]
    if not files:
        raise ValueError(f"no matching files below {root}")
    return read_csv(spark, files, schema, **options)


def read_human_ratings(spark: SparkSession, root: str) -> DataFrame:
    """Rating sheets ``<rater><digits>_…_1.csv`` / ``_2.csv`` exported as CSV.

    The rater is the name up to the first underscore without its digits.
    """
    pattern = _named(r"([^/_]+)[^/]*_[12]\.csv")
    rows = _scan(spark, root, pattern, HUMAN_SHEET)
    return rows.select(
        F.regexp_replace(_from_path(pattern), "[0-9]+", "").alias("annotator"),
        "conv_id",
        "discussion",
        F.coalesce("data_malformation", F.lit("no")).alias("data_malformation"),
        F.col("`rationale/comments`").alias("rationale"),
        *[rating_prefix(F.col(s)).alias(s) for s in SCALES],
        F.col("_metadata.file_path").alias("file_path"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def alias_raters(ratings: DataFrame, names: Sequence[str]) -> DataFrame:
    """Raters renamed A1, A2, … in the order of their names; others keep their name."""
    seat = F.array_position(F.array(*[F.lit(n) for n in sorted(names)]), F.col("annotator"))
    return ratings.withColumn(
        "annotator",
        F.when(seat > 0, F.concat(F.lit("A"), seat.cast("string"))).otherwise(F.col("annotator")),
    )


# File names as patterns with one group, the model; a prefix before it is optional.
DUAL_STEM = r"([^/=]+)_dual\.csv"
SINGLE_STEM = r"([^/=]+)_single\.csv"
PREDICTION_STEM = r"([^/=]+)_timing_([a-z]+)\.csv"
CURVE_NAME = r"/(?:[^/=]+=)?([^/]+)/(?:[^/=]+=)?pr_curves\.csv(?:/[^/]+)?$"


def read_dual_responses(
    spark: SparkSession, root: str, lenient: bool = False, stem: str = DUAL_STEM
) -> DataFrame:
    """Three-scale model answers; the model is the capitalised group of the file name."""
    name = _named(stem)
    rows = _scan(spark, root, name, RESPONSES)
    parsed = parse_dual(F.col("response"), lenient)
    return rows.select(
        _model_name(_from_path(name)).alias("model"),
        "conv_id",
        F.lit("no").alias("data_malformation"),
        *[c.alias(s) for s, c in parsed.items()],
    )


def read_single_responses(spark: SparkSession, root: str, stem: str = SINGLE_STEM) -> DataFrame:
    """Single-scale model answers."""
    name = _named(stem)
    rows = _scan(spark, root, name, RESPONSES)
    return rows.select(
        _model_name(_from_path(name)).alias("model"),
        "conv_id",
        parse_single(F.col("response")).alias("single_response"),
    )


def read_predictions(
    spark: SparkSession, root: str, schema: T.StructType = PREDICTIONS, stem: str = PREDICTION_STEM
) -> DataFrame:
    """Answers of all timing tasks; ``model`` and ``task`` are the groups of the file name."""
    name = _named(stem)
    rows = _scan(spark, root, name, schema)
    return rows.select(
        _from_path(name).alias("model"), _from_path(name, 2).alias("task"), *schema.names
    )


def read_curves(spark: SparkSession, root: str) -> DataFrame:
    """Threshold tables of many runs; the directory names the run."""
    rows = _scan(spark, root, CURVE_NAME, CURVE)
    return rows.select(_from_path(CURVE_NAME).alias("run"), *CURVE.names)
