"""Plan shape: no pairwise joins, no Python outside scoring, limits before shuffles."""

import re

import pytest

from parley.catalog import QUERIES

# Queries that run a job while they are built, for a file or a trained model.
EAGER = {
    "weighted_head", "weighted_head_report", "reply_position", "classifier_score", "stream_append", "csv_round_trip", "split_round_trip",
    "csv_single_file", "thread_order", "chunks_by_thread", "balanced_subset", "balanced_subset_2000", "sample_remainder",
    "capped_sources", "capped_sources_large", "escalation_percentile", "percentile_values",
    "tfidf", "characteristic_phrases", "characteristic_phrases_moderators",
    "lookup_scan", "human_scan", "file_name_scan", "prediction_scan", "curve_scan", "skip_existing", "surviving_groups",
}


def plan(spark, sf, name):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # Small test tables must not hide what a large table would do.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan_scales(spark, sf, name):
    text = plan(spark, sf, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if name != "batch_score":
        assert not re.search("Python|InPandas|InArrow", text)


@pytest.mark.parametrize(
    "name", ["keep_first", "pass_pairs", "frequent_phrases", "characteristic_phrases"]
)
def test_groups_are_limited_before_the_shuffle(spark, sf, name):
    text = plan(spark, sf, name)
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_only_bounded_sides_are_broadcast(spark, sf):
    # The slices that hold a cut of a split.
    broadcast = {n for n in set(QUERIES) - EAGER if "BroadcastHashJoin" in plan(spark, sf, n)}
    assert broadcast == {"stratified_split", "class_ratio_train"}


def test_scans_read_only_what_they_need(spark, sf):
    text = plan(spark, sf, "sample_counts")
    assert re.search(r"ReadSchema: struct<conv_id:bigint>", text)
    text = plan(spark, sf, "language_filter")
    assert "EqualTo(lang,en)" in text
    # Later slices of a long discussion are filtered in the scan.
    text = plan(spark, sf, "intervention_label")
    assert "GreaterThanOrEqual(turn,4096)" in text


def test_labels_need_one_shuffle_per_item(spark, sf):
    for name in ("wide_ratings", "majority_label", "align_union"):
        assert plan(spark, sf, name).count("Exchange hashpartitioning") == 1


def test_rows_do_not_depend_on_the_number_of_partitions(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in ("stratified_split", "length_batches", "pair_agreement", "bootstrap_ci", "tfidf"):
            seen = []
            for n in ("1", "23"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                rows = QUERIES[name](spark, sf)
                seen.append(sorted(map(str, rows.select(*sorted(rows.columns)).collect())))
            assert seen[0] == seen[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_groups_are_pruned_and_not_moved(spark, sf):
    text = plan(spark, sf, "surviving_groups")
    assert "dynamicpruning" in text and "CartesianProduct" not in text
    # The shares go from their pruned scan into the join; only means of groups are shuffled.
    lines = text.splitlines()
    at = next(i for i, line in enumerate(lines) if "BroadcastHashJoin" in line)
    own = [line for line in lines[at + 1 : at + 4] if "Scan parquet" in line]
    assert own and "dynamicpruning" in own[0]
    assert not any("Exchange" in line for line in lines[at + 1 : lines.index(own[0])])


def test_only_the_prompt_goes_through_python(spark, sf):
    text = plan(spark, sf, "batch_score")
    assert len(re.findall(r"EvalPython", text)) == 1
    assert "ArrowEvalPython [answer(replace(" in text
    assert "MapInPandas" not in text
