"""Readers and writers on small files, as a user would lay them out."""

import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from parley.operators.ratings import first_ratings
from parley.operators.scoring import batch_score
from parley.sources import readers, sinks
from parley.streaming.append import append_scored, stream_files


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(text)
    return str(path)


def test_corpus_with_line_breaks_and_other_column_order(spark, tmp_path):
    names = readers.COMMENT.names
    order = list(reversed(names))
    cells = dict.fromkeys(names, "")
    cells |= {"conv_id": "001", "message_id": "9", "text": '"one\n""two"", three"', "is_moderator": "1.0", "toxicity": "0.25"}
    path = write(f"{tmp_path}/c/corpus.csv", ",".join(order) + "\n" + ",".join(cells[n] for n in order) + "\n")
    row = readers.read_corpus(spark, path).first()
    assert (row["conv_id"], row["text"], row["is_moderator"], row["toxicity"]) == ("001", 'one\n"two", three', True, 0.25)
    assert row["reply_to"] is None


def test_missing_columns_raise(spark, tmp_path):
    path = write(f"{tmp_path}/l/lookup.csv", "conv_id,text\n1,a\n")
    with pytest.raises(ValueError, match="dataset"):
        readers.read_lookup(spark, path)


def test_lookup_keeps_the_first_row(spark, tmp_path):
    path = write(f"{tmp_path}/l/lookup.TSV", "text\tconv_id\tdataset\nfirst\t07\ta\nagain\t07\tb\n")
    assert [tuple(r) for r in readers.read_lookup(spark, path).collect()] == [("07", "first", "a")]


def test_rating_sheets(spark, tmp_path):
    head = "conv_id,discussion,data_malformation,rationale/comments,positive_reinforcement,negative_reinforcement,no_reinforcement\n"
    write(f"{tmp_path}/s/x/zoe12_part_1.csv", head + "7,text,,why,4 – strong,,1 – low\n")
    write(f"{tmp_path}/s/zoe3_part_2.csv", head + "7,text,yes,,2 – weak,1 – low,\n")
    write(f"{tmp_path}/s/adam_1.csv", head + "8,text,no,,,,5 – yes\n")
    write(f"{tmp_path}/s/notes_3.csv", "other\nx\n")
    rows = readers.read_human_ratings(spark, f"{tmp_path}/s")
    assert {r["annotator"] for r in rows.collect()} == {"zoe", "adam"}
    first = readers.alias_raters(first_ratings(rows, ["file_path", "row_no"]), ["zoe", "adam"])
    got = {(r["annotator"], r["conv_id"]): tuple(r[s] for s in readers.SCALES) for r in first.collect()}
    assert set(got) == {("A1", "8"), ("A2", "7")}
    assert got["A2", "7"] == (4, 0, 1)


def test_answer_files_name_their_model(spark, tmp_path):
    root = f"{tmp_path}/a"
    write(f"{root}/MODEL7b_dual.csv", "response,conv_id\nPositive: 3,1\n")
    write(f"{root}/deep/small7b_single.csv", "conv_id,response\n1,about 4\n2,unsure\n")
    write(f"{root}/small7b_timing_prediction.csv",
          "message_id,dataset,is_moderator,should_intervene,response\n5,ceri,False,1.0,yes\n")
    write(f"{root}/other.csv", "a,b\n1,2\n")
    dual = readers.read_dual_responses(spark, root).first()
    assert (dual["model"], dual["positive_reinforcement"]) == ("Model7b", 3)
    single = {r["conv_id"]: (r["model"], r["single_response"]) for r in readers.read_single_responses(spark, root).collect()}
    assert single == {"1": ("Small7b", 4.0), "2": ("Small7b", None)}
    row = readers.read_predictions(spark, root).first()
    assert (row["model"], row["task"], row["response"], row["is_moderator"]) == ("small7b", "prediction", "yes", False)


def test_different_headers_raise_instead_of_mixing_columns(spark, tmp_path):
    root = f"{tmp_path}/h"
    write(f"{root}/a_single.csv", "conv_id,response\n1,2\n")
    write(f"{root}/b_single.csv", "response,conv_id\n2,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_single_responses(spark, root).collect()


def test_curves_name_their_run(spark, tmp_path):
    for run in ("written", "spoken"):
        write(f"{tmp_path}/r/{run}/pr_curves.csv", ",Threshold,Precision,Recall,F1\n0,0.0,0.5,1.0,0.6667\n")
    got = readers.read_curves(spark, f"{tmp_path}/r")
    assert {r["run"] for r in got.collect()} == {"written", "spoken"}


def test_csv_keeps_text_as_it_was(spark, tmp_path):
    texts = ["a", "", None, ' lead "q" ', "x\ny\r\nz", "comma, tail ", "\\", "nan"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "conv_id string, response string")
    sinks.write_csv(rows.coalesce(1), f"{tmp_path}/out")
    got = readers.read_csv(spark, f"{tmp_path}/out", readers.RESPONSES).collect()
    # An empty field is a missing value.
    assert {r["conv_id"]: r["response"] for r in got} == {str(i): t or None for i, t in enumerate(texts)}


def test_a_finished_output_is_not_built_again(spark, tmp_path):
    path = f"{tmp_path}/once"

    def never():
        raise AssertionError("built again")

    assert sinks.write_once(spark, path, lambda: spark.range(3).toDF("x"))
    assert not sinks.write_once(spark, path, never)
    assert sinks.read_once(spark, path).count() == 3


def test_writers_that_start_together_leave_one_result(spark, tmp_path):
    path, started = f"{tmp_path}/once", threading.Barrier(4)

    def writer(n):
        def build():
            started.wait()
            return spark.range(100 * n, 100 * n + 100).toDF("x")

        return sinks.write_once(spark, path, build)

    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(writer, range(4)))
    assert sum(won) == 1
    rows = sorted(r["x"] for r in sinks.read_once(spark, path).collect())
    assert rows == list(range(100 * won.index(True), 100 * won.index(True) + 100))
    # The losers' rows are gone.
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{path}/attempts").count() == 100


def test_a_writer_that_dies_leaves_no_result(spark, tmp_path):
    path = f"{tmp_path}/once"

    def broken():
        return spark.range(10).select(F.raise_error(F.lit("lost")).alias("x"))

    with pytest.raises(Exception, match="lost"):
        sinks.write_once(spark, path, broken)
    assert not sinks.already_written(spark, path)
    with pytest.raises(FileNotFoundError):
        sinks.read_once(spark, path)
    # Nor does one that dies between its rows and its commit.
    spark.range(5).toDF("x").write.parquet(f"{path}/attempts/dead")
    assert sinks.write_once(spark, path, lambda: spark.range(3).toDF("x"))
    assert sinks.read_once(spark, path).count() == 3
    # A commit that comes too late changes nothing.
    sinks._commit(spark, path, "dead")
    assert sinks.read_once(spark, path).count() == 3


def test_stream_appends_each_file_once(spark, tmp_path):
    arrived, out, progress = (f"{tmp_path}/{n}" for n in ("in", "out", "progress"))
    schema = "message_id string, text string"

    def run():
        stream = stream_files(spark, arrived, spark.createDataFrame([], schema).schema)
        append_scored(stream, lambda df: batch_score(df, text="text"), out, progress).awaitTermination()
        return {r["message_id"]: r["response"] for r in spark.read.parquet(out).collect()}

    spark.createDataFrame([("1", "why?"), ("2", "so.")], schema).write.parquet(arrived)
    assert run() == {"1": "1", "2": "0"}
    spark.createDataFrame([("3", None)], schema).write.mode("append").parquet(arrived)
    assert run() == {"1": "1", "2": "0", "3": "0"}
    assert spark.read.parquet(out).count() == 3


def test_scorer_sees_whole_batches_and_the_prompt(spark):
    class Echo:
        def __call__(self, system_prompt, texts):
            return system_prompt + texts.str.len().astype(str)

    rows = spark.createDataFrame([("a moderator",), (None,)], "discussion string")
    got = [r["response"] for r in batch_score(rows.coalesce(1), Echo, "n=").collect()]
    assert got == ["n=3", "n=3"]
    assert batch_score(rows, Echo).columns == ["discussion", "response"]


def test_split_scan_prunes_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", "train"), ("2", "a", "test"), ("3", "b", "test")], "message_id string, dataset string, split string")
    sinks.write_splits(rows, f"{tmp_path}/splits")
    got = readers.read_split(spark, f"{tmp_path}/splits", "test", ["a"])
    assert [r["message_id"] for r in got.collect()] == ["2"]
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().executedPlan().toString()
    assert got.where(F.col("dataset") == "b").count() == 0
