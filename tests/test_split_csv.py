"""One CSV file read in byte ranges of any size gives the rows a plain CSV reader gives."""

import csv
import random

import pytest
from pyspark.sql import types as T

from parley.sources import readers, split_csv

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c")])


def rows(seed=1, n=150):
    rng = random.Random(seed)
    bits = ["x", '"', "\n", "\n\n", ",", "é", "日本", "\r\n", " ", "long " * 20, "", '""', "\\"]
    out = [(str(i), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8))), str(rng.randint(0, 9))) for i in range(n)]
    return [*out, ("big", "line\n" * 300, "1"), ("quotes", '"\n"' * 80, "2"), ("last", "", "")]


def write(path, found, end="\n", header=("a", "b", "c"), last=True):
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file, lineterminator=end)
        writer.writerow(header)
        writer.writerows(found)
    if not last:
        path.write_bytes(path.read_bytes().removesuffix(end.encode()))


def plain(spark, path):
    return sorted(spark.read.options(**readers.CSV_OPTIONS).schema(SCHEMA).csv(str(path)).collect(), key=str)


@pytest.mark.parametrize("split_bytes", [29, 300, 4_000, None])
def test_same_rows_at_any_size(spark, tmp_path, split_bytes):
    path = tmp_path / "one.csv"
    write(path, rows())
    got = readers.read_corpus(spark, str(path), SCHEMA, split_bytes)
    assert sorted(got.collect(), key=str) == plain(spark, path)
    if split_bytes and split_bytes < 1_000:
        assert len(got.inputFiles()) > 3


@pytest.mark.parametrize("end,last", [("\r\n", True), ("\n", False), ("\r\n", False)])
def test_line_ends(spark, tmp_path, end, last):
    path, found = tmp_path / "one.csv", [("1", "x\ny", "z"), ("2", 'say "hi"', "w"), ("3", "", "last")]
    write(path, found, end, last=last)
    for size in (11, None):
        got = readers.read_corpus(spark, str(path), SCHEMA, size).collect()
        assert sorted(map(tuple, got)) == [("1", "x\ny", "z"), ("2", 'say "hi"', "w"), ("3", None, "last")]


def test_blank_lines_are_no_records(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text('\na,b,c\n\n1,"x\n\ny",2\n\n\n3,4,5\n\n')
    for size in (5, 13, None):
        got = sorted(map(tuple, split_csv.read(spark, str(path), SCHEMA, readers._typed, size).collect()))
        assert got == [("1", "x\n\ny", "2"), ("3", "4", "5")]


def test_several_files_types_and_column_order(spark, tmp_path):
    schema = T.StructType([T.StructField("b", T.BooleanType()), T.StructField("a", T.DoubleType())])
    write(tmp_path / "0.csv", [("0", "True", "x\n" * 30)])
    write(tmp_path / "1.csv", [("1", "1.0", "x\n" * 30)])
    write(tmp_path / "2.csv", [])
    got = readers.read_corpus(spark, str(tmp_path), schema, 40)
    assert got.schema == schema
    assert sorted(map(tuple, got.collect())) == [(True, 0.0), (True, 1.0)]


def test_other_headers_and_missing_columns_raise(spark, tmp_path):
    write(tmp_path / "0.csv", [("1", "2", "3")])
    with pytest.raises(ValueError, match="missing"):
        readers.read_corpus(spark, str(tmp_path), T.StructType([T.StructField("z", T.StringType())]))
    write(tmp_path / "1.csv", [("1", "2", "3")], header=("b", "a", "c"))
    with pytest.raises(ValueError, match="headers"):
        readers.read_corpus(spark, str(tmp_path), SCHEMA)


def test_a_quote_never_closed_is_one_record(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text('a,b,c\n1,2,3\n4,"5\n6,7\n8,9,\n')
    got = readers.read_corpus(spark, str(path), SCHEMA, 6).collect()
    assert len(got) == 2 and sorted(r["a"] for r in got) == ["1", "4"]


def test_settings_are_put_back(spark, tmp_path):
    write(tmp_path / "0.csv", [("1", "2", "3")])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    readers.read_corpus(spark, str(tmp_path), SCHEMA, 7)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
