"""Rows that once gave wrong answers without an error."""

from pyspark.sql import functions as F

from parley.functions.labels import decide, decide_logit
from parley.operators.context import ancestors, reply_depth, with_context, with_context_length
from parley.operators.metrics import threshold_sweep
from parley.operators.ordering import next_value, position_in_key
from parley.operators.sampling import stratified_split
from parley.operators.scoring import batch_score, linear_score
from parley.sources import readers

NAN = float("nan")


def test_scoring_twice_leaves_the_input_alone(spark):
    df = spark.createDataFrame([(1, "please?"), (2, "no"), (3, None)], "id long, discussion string")
    first = batch_score(df)
    assert df.schema.names == ["id", "discussion"]
    second = batch_score(df)
    assert first.columns == second.columns == ["id", "discussion", "response"]
    assert [r["response"] for r in second.orderBy("id").collect()][:2] == ["1", "0"]
    assert df.count() == 3


def test_scores_that_are_no_numbers_are_not_positive(spark):
    df = spark.createDataFrame([(NAN, 1), (0.9, 1), (None, 0), (0.1, 0)], "score double, label int")
    row = threshold_sweep(df, thresholds=[0.5]).first()
    assert (row["predicted"], row["tp"], row["precision"], row["recall"]) == (1, 1, 1.0, 0.5)
    got = df.select(decide(F.col("score")).alias("d"), decide_logit(F.col("score")).alias("l")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 1), (None, None), (0, 1)]


def test_repeated_lookup_ids_do_not_fork_a_chain(spark):
    rows = [("1", None, "a"), ("2", "1", "b"), ("3", "2", "c"), ("4", "3", "d")]
    schema = "message_id string, reply_to string, text string"
    lookup = spark.createDataFrame(rows + rows[:3] + [("2", "1", "b again")], schema)
    target = spark.createDataFrame(rows[3:], schema)
    for small in (False, True):
        row = with_context(target, lookup, small_targets=small).first()
        assert row["n_ancestors"] == 3
        assert row["discussion"] == "<CTX>a</CTX> <CTX>b</CTX> <CTX>c</CTX> <TGT>d</TGT>"
        assert with_context_length(target, lookup, small_targets=small).first()["est_length"] == 4
        assert ancestors(target, lookup, small_targets=small).count() == 3


def test_every_class_is_split(spark):
    df = spark.createDataFrame([(str(i), c) for c in (0.0, 1.0, 2.0) for i in range(int(c) * 100, int(c) * 100 + 100)]
                               + [("none", None)], "message_id string, y double")
    counts = {(r["y"], r["split"]): r["count"] for r in stratified_split(df, "y").groupBy("y", "split").count().collect()}
    assert counts == {(c, s): n for c in (0.0, 1.0, 2.0) for s, n in (("train", 60), ("val", 20), ("test", 20))}
    named = df.select("message_id", F.concat(F.lit("c"), "y").alias("y"))
    assert stratified_split(named, "y").count() == 300


def test_positions_below_zero(spark):
    rows = [("a", p, p) for p in (-5, -2, -1, 0, 1, 4, 5)] + [("b", p, p) for p in (0, 3)] + [("c", 7, 7), ("c", -9, -9)]
    df = spark.createDataFrame(rows, "k string, p int, v int")
    for width in (2, 3, 100):
        ranks = {(r["k"], r["p"]): r["rank"] for r in position_in_key(df, "k", "p", "rank", width).collect()}
        after = {(r["k"], r["p"]): r["after"] for r in next_value(df, "k", "p", "v", "after", width).collect()}
        for key in "abc":
            own = sorted(p for k, p, _ in rows if k == key)
            assert [ranks[key, p] for p in own] == list(range(1, len(own) + 1))
            assert [after[key, p] for p in own] == [*own[1:], None]


def test_rows_of_keys_below_zero_come_once(spark):
    places = {"a": (-1, 0, 1, 5000), "b": (0, 1, 4096), "c": (-9, 7), "d": (5000, 9000), "e": (-5000, -1), "f": (3,)}
    rows = [(k, p, p) for k, own in places.items() for p in own]
    df = spark.createDataFrame(rows, "k string, p int, v int")
    for width in (2, 100, 4096):
        want = sorted((k, p, n) for k, own in places.items() for p, n in zip(own, [*own[1:], None], strict=True))
        got = next_value(df, "k", "p", "v", "after", width).select("k", "p", "after").collect()
        assert sorted(map(tuple, got)) == want


def test_files_with_an_index_column_are_read_by_name(spark, tmp_path):
    for run, text in (
        ("one", ",Threshold,Precision,Recall,F1\n0,0.1,0.2,0.3,0.4\n"),
        ("two", ",F1,Recall,Precision,Threshold\n0,0.4,0.3,0.2,0.1\n"),
    ):
        folder = tmp_path / "r" / run
        folder.mkdir(parents=True)
        (folder / "pr_curves.csv").write_text(text)
    got = readers.read_curves(spark, f"{tmp_path}/r").collect()
    assert {tuple(r) for r in got} == {(run, 0.1, 0.2, 0.3, 0.4) for run in ("one", "two")}


def test_unknown_raters_keep_their_names(spark):
    df = spark.createDataFrame([("zoe",), ("adam",), ("eve",), ("ivo",)], "annotator string")
    got = [r["annotator"] for r in readers.alias_raters(df, ["zoe", "adam"]).collect()]
    assert got == ["A2", "A1", "eve", "ivo"]


def test_linear_scores_by_hand(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [None, 1.0])], "id int, v array<double>")
    got = {r["id"]: (r["score"], r["decision"]) for r in linear_score(df, "v", [2.0, -1.0], 0.0).collect()}
    assert got == {1: (0.5, 1), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_depth_along_replies(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(37)]
    rows = chain + [("x", "unknown"), ("y", "x"), ("c1", "c2"), ("c2", "c1"), ("above", "c1"), ("self", "self"), ("3", "2"), (None, "1")]
    df = spark.createDataFrame(rows, "message_id string, reply_to string")
    got = {r["message_id"]: r["depth"] for r in reply_depth(df).collect()}
    want = {str(i): i for i in range(37)} | {"x": 0, "y": 1, "c1": None, "c2": None, "above": None, "self": None}
    assert got == want
    assert reply_depth(df.limit(0)).count() == 0
