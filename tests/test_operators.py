"""Operators on small literal tables, against brute force and known values."""

import itertools
import math
import random
from collections import Counter
from statistics import mean

import pytest
from pyspark.sql import functions as F

from parley import views as V
from parley.operators import agreement as A
from parley.operators import corpus as C
from parley.operators import metrics as M
from parley.operators import ordering as O
from parley.operators import phrases as P
from parley.operators import ratings as R
from parley.operators import sampling as S
from parley.operators import statistics as T
from parley.operators import tables as B
from parley.operators.batches import length_batches
from parley.operators.context import (
    ancestors,
    intervention_label,
    unique_lookup,
    with_context,
    with_context_length,
)
from parley.operators.selection import exact_percentile
from parley.operators.phrases import document_phrases, frequent_phrases, tfidf
from parley.session import pinned

COMMENT = "message_id string, reply_to string, text string"


def comments(spark, rows):
    return spark.createDataFrame(rows, COMMENT)


def context_of(spark, rows, target, **options):
    table = comments(spark, rows)
    targets = table.where(F.col("message_id") == target)
    return with_context(targets, table, **options).first()


CHAIN = [("1", None, "a"), ("2", "1", "b"), ("3", "2", "c"), ("4", "3", "d"), ("5", "4", "e")]


@pytest.mark.parametrize("small", [False, True])
def test_context_is_bounded_and_oldest_first(spark, small):
    row = context_of(spark, CHAIN, "5", small_targets=small)
    assert row["discussion"] == "<CTX>b</CTX> <CTX>c</CTX> <CTX>d</CTX> <TGT>e</TGT>"
    assert row["n_ancestors"] == 3
    assert context_of(spark, CHAIN, "1", small_targets=small)["discussion"] == "<TGT>a</TGT>"


@pytest.mark.parametrize("small", [False, True])
def test_context_stops_at_unknown_parent(spark, small):
    row = context_of(spark, [("1", "gone", "a")], "1", small_targets=small)
    assert (row["discussion"], row["n_ancestors"]) == ("<TGT>a</TGT>", 0)


def test_context_of_a_cycle_terminates(spark):
    row = context_of(spark, [("1", "2", "a"), ("2", "1", "b")], "1")
    assert row["discussion"] == "<CTX>b</CTX> <CTX>a</CTX> <CTX>b</CTX> <TGT>a</TGT>"


def test_context_null_text_and_length(spark):
    table = comments(spark, [("1", None, None), ("2", "1", "abcd")])
    row = with_context(table, table).where("message_id = '2'").first()
    assert row["discussion"] == "<CTX>nan</CTX> <TGT>abcd</TGT>"
    sizes = {r["message_id"]: r["est_length"] for r in with_context_length(table, table).collect()}
    assert sizes == {"1": 3, "2": 7}


def test_repeated_lookup_ids_do_not_multiply_rows(spark):
    table = spark.createDataFrame(
        [("1", None, "first", 1), ("1", None, "again", 2), ("2", "1", "b", 3)],
        COMMENT + ", row_no int",
    )
    lookup = unique_lookup(table, ["row_no"])
    out = with_context(table.where("message_id = '2'"), lookup).collect()
    assert [r["discussion"] for r in out] == ["<CTX>first</CTX> <TGT>b</TGT>"]


def test_context_of_a_root_with_most_replies(spark):
    rows = [("root", None, "r")] + [(str(i), "root", "x") for i in range(500)]
    out = with_context(comments(spark, rows), comments(spark, rows))
    assert out.where("n_ancestors = 1").count() == 500
    assert ancestors(comments(spark, rows), comments(spark, rows)).count() == 500


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_slices_do_not_change_label_or_position(spark, width):
    random.seed(1)
    rows = []
    for conv in ("hot", "b", "c"):
        turns = sorted(random.sample(range(60), 40 if conv == "hot" else 5))
        rows += [(conv, t, random.random() < 0.4) for t in turns]
    table = spark.createDataFrame(rows, "conv_id string, turn long, is_moderator boolean")
    nexts, places = {}, {}
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = list(group)
        for i, (_, turn, _) in enumerate(group):
            nexts[conv, turn] = group[i + 1][2] if i + 1 < len(group) else None
            places[conv, turn] = i + 1
    got = O.next_value(table, "conv_id", "turn", "is_moderator", "n", width=width).collect()
    assert {(r["conv_id"], r["turn"]): r["n"] for r in got} == nexts
    got = O.position_in_key(table, "conv_id", "turn", "p", width=width).collect()
    assert {(r["conv_id"], r["turn"]): r["p"] for r in got} == places


def test_intervention_label(spark):
    rows = [("c", 0, False), ("c", 1, True), ("c", 2, False), ("c", 3, False)]
    table = spark.createDataFrame(rows, "conv_id string, turn long, is_moderator boolean")
    got = {r["turn"]: r["should_intervene"] for r in intervention_label(table).collect()}
    assert got == {0: 1.0, 1: None, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize("digits", [1, 3])
def test_global_rank_with_one_common_major_value(spark, digits):
    rows = spark.range(300).select(
        F.when(F.col("id") < 200, 7).otherwise(F.col("id") % 5).alias("m"),
        F.md5(F.col("id").cast("string")).alias("h"), "id",
    )
    got = O.global_rank(rows, "h", "id", "r", major="m", digits=digits).collect()
    order = sorted(got, key=lambda r: (r["m"], r["h"], r["id"]))
    assert [r["r"] for r in order] == list(range(1, 301))


@pytest.mark.parametrize("p", [0.0, 0.025, 0.25, 0.5, 0.6, 0.9, 0.975, 1.0])
@pytest.mark.parametrize("n", [1, 2, 7, 72, 1000])
def test_exact_percentile(spark, p, n):
    random.seed(n)
    rows = [(random.choice([0.0, 0.5, random.random()]),) for _ in range(n)]
    table = spark.createDataFrame(rows, "x double")
    want = table.agg(F.percentile("x", F.lit(p))).first()[0]
    got = spark.range(1).select(exact_percentile(table, "x", p)).first()[0]
    assert got == pytest.approx(want, abs=1e-12)


def test_exact_percentile_with_a_coarse_sketch(spark):
    table = spark.range(5000).select((F.pmod(F.hash("id"), F.lit(1999)) / 7.0).alias("x"))
    want = table.agg(F.percentile("x", F.lit(0.6))).first()[0]
    got = spark.range(1).select(exact_percentile(table, "x", 0.6, accuracy=50)).first()[0]
    assert got == pytest.approx(want, abs=1e-12)


def test_keep_first_uses_the_given_order(spark):
    table = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 5, "c")], "k string, n int, v string")
    assert sorted((r["k"], r["v"]) for r in O.keep_first(table, ["k"], ["n"]).collect()) == [("j", "c"), ("k", "a")]


def test_first_k_beyond_the_group_limit(spark):
    table = spark.range(0, 5000, 1, 16).select((F.col("id") % 2).alias("k"), "id")
    got = O.first_k(table, ["k"], ["id"], 1200).groupBy("k").agg(F.count("*"), F.max("id")).collect()
    assert sorted(map(tuple, got)) == [(0, 1200, 2398), (1, 1200, 2399)]


@pytest.fixture(scope="module")
def targets(spark):
    return spark.range(2000).select(
        F.col("id").cast("string").alias("message_id"),
        F.lit(None).cast("string").alias("reply_to"),
        F.lit("t").alias("text"),
        F.when(F.col("id") < 1500, "big").when(F.col("id") < 1990, "mid").otherwise("tiny").alias("dataset"),
        (F.col("id") % 3 == 0).cast("double").alias("y"),
    )


def test_split_is_exact_disjoint_and_complete(targets):
    split = S.stratified_split(targets, "y")
    counts = {(r["y"], r["split"]): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert sum(counts.values()) == 2000 == split.select("message_id").distinct().count()
    for y, n in ((1.0, 667), (0.0, 1333)):
        assert abs(counts[y, "train"] - 0.6 * n) <= 1
        assert abs(counts[y, "val"] - 0.2 * n) <= 1
        assert abs(counts[y, "test"] - 0.2 * n) <= 1


def test_split_does_not_depend_on_partitions(targets):
    one = S.stratified_split(targets.coalesce(1), "y").select("message_id", "split")
    many = S.stratified_split(targets.repartition(17), "y").select("message_id", "split")
    assert one.exceptAll(many).count() == 0


@pytest.mark.parametrize("n", [5, 60, 700, 2500])
def test_balanced_subset_tops_up_without_repeats(targets, n):
    rows = S.balanced_subset(targets, targets, n=n).select("message_id", "dataset", "origin").collect()
    assert len(rows) == min(n, 2000) == len({r["message_id"] for r in rows})
    quota = n // 3
    for name, size in (("big", 1500), ("mid", 490), ("tiny", 10)):
        from_quota = [r for r in rows if r["dataset"] == name and r["origin"] == "quota"]
        assert len(from_quota) == min(quota, size)


def test_balanced_ids_have_no_upper_bound(targets):
    assert S.balanced_ids(targets, S.SMALL_TARGETS + 1).count() == 2000
    with pytest.raises(ValueError):
        S.balanced_ids(targets, 0)


def test_remainder(targets):
    taken = S.balanced_ids(targets, 60)
    assert S.remainder(targets, taken).count() == 1940


def test_length_batches(spark):
    rows = spark.range(205).select(F.col("id").cast("string").alias("message_id"), (F.col("id") % 9).alias("est_length"))
    got = length_batches(rows, batch_size=20).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["batch_id"], []).append(r["est_length"])
    assert sorted(map(len, sizes.values())) == [5] + [20] * 10
    assert all(max(sizes[i]) <= min(sizes[i + 1]) for i in range(10))
    assert sorted({r["batch_order"] for r in got}) == list(range(1, 12))
    again = length_batches(rows, batch_size=20, epoch=1, drop_last=True)
    assert again.select("batch_id").distinct().count() == 10


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


def test_threshold_hit_counts_and_recall_falls(spark):
    rows = [(0.5, 1), (0.0, 0), (1.0, 1), (0.3, 0), (0.15, 1)]
    got = {r["threshold"]: r for r in M.threshold_sweep(scored(spark, rows)).collect()}
    assert len(got) == 21
    for t in M.THRESHOLDS:
        predicted = [label for score, label in rows if score >= t]
        assert (got[t]["predicted"], got[t]["tp"]) == (len(predicted), sum(predicted))
    recalls = [got[t]["recall"] for t in M.THRESHOLDS]
    assert recalls == sorted(recalls, reverse=True)


def test_metrics_without_predicted_positives(spark):
    rows = spark.createDataFrame([(1, 0), (0, 0), (None, 1), (2, 1)], "y int, p int")
    row = M.evaluate(rows, F.col("y"), F.col("p")).first()
    assert (row["precision"], row["recall"], row["f1p"]) == (0.0, 0.0, 0.0)
    assert (row["accuracy"], row["support_rows"], row["support_pos"]) == (0.5, 2, 1)


def test_metrics_without_usable_rows(spark):
    rows = spark.createDataFrame([("m", "d", None), ("m", "e", 1)], "model string, dataset string, p int")
    got = {
        r["dataset"]: r
        for r in M.evaluate_by_dataset(rows, F.lit(1), F.col("p")).collect()
    }
    assert got["d"]["precision"] is None and got["d"]["support_rows"] == 0
    # The mean row skips it.
    assert got["All"]["precision"] == 1.0 and got["All"]["support_rows"] == 1


def test_macro_f1_skips_an_absent_class(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    assert M.evaluate(rows, F.col("y"), F.col("p")).first()["macro_f1"] == 1.0


def test_reshape_keeps_underscores_in_names(spark):
    rows = spark.createDataFrame(
        [("eval_cmv_awry_f1", 0.5), ("eval_loss", 1.0), ("eval_cmv_awry_loss", 2.0), ("epoch", 3.0)],
        "key string, value double",
    )
    got = {r["dataset"]: (r["loss"], r["accuracy"], r["f1"]) for r in M.reshape_run_metrics(rows).collect()}
    assert got == {"cmv_awry": (2.0, None, 0.5), "ALL": (1.0, None, None)}


RATING = "annotator string, is_human boolean, conv_id string, pass_no int, " + ", ".join(
    f"{s} int" for s in R.SCALES
) + ", data_malformation string"


def ratings(spark, rows):
    return spark.createDataFrame(rows, RATING)


def test_majority_takes_the_smallest_label_on_ties(spark):
    labels = [("m1", 3), ("m2", 1), ("m3", 3), ("m4", 1), ("m5", 0), ("A1", 2), ("A2", 1)]
    rows = spark.createDataFrame([("i", a, v) for a, v in labels], "conv_id string, annotator string, label int")
    row = R.majority(rows, ["A1", "A2"], ["m1", "m2", "m3", "m4", "m5"]).first()
    assert (row["llm_mode"], row["llm_agreement"], row["n_humans_agree"]) == (1, 0.4, 1)


def test_wide_and_aligned_tables_keep_the_first_pass(spark):
    table = ratings(spark, [
        ("A1", True, "i", 2, 5, 5, 5, "no"), ("A1", True, "i", 1, 1, 2, 3, "yes"),
        ("M", False, "j", 1, 4, 4, 4, "no"), ("M", False, "i", 1, 2, 2, 2, "no"),
    ])
    wide = R.wide_ratings(table, ["A1"], ["M"]).collect()
    # Item j has no human rating.
    assert [r["conv_id"] for r in wide] == ["i"]
    assert (wide[0]["A1_positive_reinforcement"], wide[0]["total_malformed"]) == (1, 1.0)
    aligned = R.align_to_panel(table, ["A1", "M"])
    got = {(r["conv_id"], r["annotator"]): (r["no_reinforcement"], r["data_malformation"]) for r in aligned.collect()}
    assert got == {("i", "A1"): (3, "yes"), ("i", "M"): (2, "no"), ("j", "A1"): (None, "no"), ("j", "M"): (4, "no")}


def test_repeated_rows_and_pairs(spark):
    rows = [("A1", True, "i", p, p, 0, 0, "no") for p in (1, 2, 3)] + [("A1", True, "j", 1, 1, 0, 0, "no")]
    table = ratings(spark, rows)
    assert R.repeated_rows(table).count() == 3
    pairs = R.pass_pairs(table, F.col("positive_reinforcement")).collect()
    assert [(r["pass_1"], r["pass_2"]) for r in pairs] == [(1, 2)]
    assert R.self_consistency(R.pass_pairs(table, F.lit(0))).first()["pct_agreement"] == 100.0


def vectors(spark, rows, raters):
    flat = [
        (a, True, str(i), 1, v, 0, 0, "no")
        for a, values in zip(raters, rows)
        for i, v in enumerate(values)
        if v is not None
    ]
    return A.rating_vectors(ratings(spark, flat), raters, scales=["positive_reinforcement"])


def test_alpha_of_the_published_example(spark):
    # Four observers, twelve units, ordinal: 0.815.
    observers = [
        [1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None],
        [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3],
        [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None],
        [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None],
    ]
    raters = ["a", "b", "c", "d"]
    row = A.ordinal_alpha(vectors(spark, observers, raters), raters, {"g": raters}).first()
    assert round(row["krippendorff_alpha"], 3) == 0.815


def test_identical_raters_agree_fully(spark):
    raters = ["a", "b"]
    v = vectors(spark, [[1, 2, 3, 5, 5]] * 2, raters)
    assert A.ordinal_alpha(v, raters, {"g": raters}).first()["krippendorff_alpha"] == pytest.approx(1)
    row = A.pair_agreement(A.pair_contingency(v, raters)).first()
    assert [row["pearson_r"], row["spearman_rho"], row["weighted_kappa"]] == pytest.approx([1, 1, 1])


def test_sweep_rounds_when_asked(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.9, 0), (0.1, 1)], "score double, label int")
    whole = M.threshold_sweep(rows, thresholds=[0.5]).first()
    short = M.threshold_sweep(rows, thresholds=[0.5], digits=4).first()
    assert (short["precision"], short["recall"], short["f1"]) == (0.3333, 0.5, 0.4)
    assert whole["precision"] == 1 / 3


def test_a_panel_of_a_thousand_raters(spark):
    # Every rater judges items 0 and 1, the even ones item 2; rater 7 alone disagrees.
    raters = [f"r{i:04d}" for i in range(1_000)]
    rows = [[1, 4 if i != 7 else 2, 5 if i % 2 == 0 else None] for i in range(1_000)]
    v = vectors(spark, rows, raters).cache()
    assert v.count() == 3 and max(r["n"] for r in v.selectExpr("size(vector) as n").collect()) == 1_000
    cells = A.pair_contingency(v, raters).cache()
    assert cells.agg(F.sum("n")).first()[0] == 2 * (1_000 * 999 // 2) + 500 * 499 // 2
    assert cells.where("rater_1 >= rater_2").count() == 0
    assert cells.where("value_1 <> value_2").agg(F.sum("n")).first()[0] == 999
    two = {"pair": [raters[0], raters[7]], "all": raters}
    alphas = {r["rater_group"]: r["krippendorff_alpha"] for r in A.ordinal_alpha(v, raters, two).collect()}
    few = vectors(spark, [rows[0], rows[7]], [raters[0], raters[7]])
    alone = A.ordinal_alpha(few, [raters[0], raters[7]], {"pair": [raters[0], raters[7]]}).first()
    assert alphas["pair"] == pytest.approx(alone["krippendorff_alpha"]) and 0.9 < alphas["all"] < 1


def test_constant_rater_has_no_correlation(spark):
    raters = ["a", "b"]
    v = vectors(spark, [[2, 2, 2], [1, 3, 2]], raters)
    row = A.pair_agreement(A.pair_contingency(v, raters)).first()
    assert row["pearson_r"] is None and row["spearman_rho"] is None and row["weighted_kappa"] == 0.0


def _brute(x, y):
    def pearson(a, b):
        ma, mb = mean(a), mean(b)
        top = sum((p - ma) * (q - mb) for p, q in zip(a, b))
        return top / (sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b)) ** 0.5

    def ranks(a):
        return [sum(q < p for q in a) + (sum(q == p for q in a) + 1) / 2 for p in a]

    used = sorted(set(x) | set(y))
    i, j = [used.index(p) for p in x], [used.index(q) for q in y]
    seen = sum((p - q) ** 2 for p, q in zip(i, j))
    chance = sum((p - q) ** 2 for p in i for q in j) / len(i)
    return pearson(x, y), pearson(ranks(x), ranks(y)), 1 - seen / chance


def test_pair_statistics_equal_brute_force(spark):
    random.seed(3)
    raters = ["a", "b", "c"]
    # One rater uses only 1 and 5, so kappa must weigh by place, not by value.
    data = [[random.choice([1, 5]) for _ in range(40)]] + [
        [random.choice([1, 2, 5, None]) for _ in range(40)] for _ in range(2)
    ]
    got = A.pair_agreement(A.pair_contingency(vectors(spark, data, raters), raters)).collect()
    assert len(got) == 3
    for row in got:
        x, y = data[raters.index(row["rater_1"])], data[raters.index(row["rater_2"])]
        both = [(p, q) for p, q in zip(x, y) if p is not None and q is not None]
        want = _brute([p for p, _ in both], [q for _, q in both])
        assert row["n_samples"] == len(both)
        assert [row["pearson_r"], row["spearman_rho"], row["weighted_kappa"]] == pytest.approx(list(want))


def test_phrases_against_brute_force(spark):
    texts = [
        ("1", "d", "alpha beta gamma alpha beta gamma"), ("2", "d", "alpha beta"),
        ("3", "e", "x the gamma"), ("4", "e", None), ("5", "d", "beta gamma of delta"),
    ]
    table = spark.createDataFrame(texts, "doc string, dataset string, text string")
    tf = {(r["doc"], r["phrase"]): r["tf"] for r in document_phrases(table, "doc").collect()}
    assert tf["1", "alpha beta"] == 2 and tf["1", "gamma alpha beta"] == 1
    # Stop words go first, then words meet: "gamma of delta" gives "gamma delta".
    assert tf["5", "beta gamma delta"] == 1 and not any(doc in ("3", "4") for doc, _ in tf)
    top = [(r["phrase"], r["n"]) for r in frequent_phrases(table, "doc").orderBy("rank").collect()]
    assert top == [("alpha beta", 3), ("beta gamma", 3)]
    weights = {(r["doc"], r["phrase"]): r["tfidf"] for r in tfidf(table, "doc").collect()}
    assert sum(w * w for (doc, _), w in weights.items() if doc == "1") == pytest.approx(1)
    assert weights["2", "alpha beta"] == pytest.approx(1)


def _top_phrases(texts, top, min_df=2):
    n, df = Counter(), Counter()
    for _, dataset, text in texts:
        words = (text or "").split()
        found = Counter(" ".join(words[i : i + k]) for k in (2, 3) for i in range(len(words) - k + 1))
        n.update({(dataset, p): m for p, m in found.items()})
        df.update((dataset, p) for p in found)
    rows = []
    for dataset in {d for _, d, _ in texts}:
        kept = sorted((-m, p) for (d, p), m in n.items() if d == dataset and df[d, p] >= min_df)
        rows += [(dataset, p, -m, at + 1) for at, (m, p) in enumerate(kept[:top])]
    return sorted(rows, key=lambda row: tuple(map(repr, row)))


@pytest.mark.parametrize(("slots", "first"), [(4, 1), (64, 2), (512, 16), (16_384, 512)])
def test_frequent_phrases_by_slots(spark, monkeypatch, slots, first):
    draw, words = random.Random(5), [a + b + "q" for a in "bcdfg" for b in "klmnp"]
    # Steep and flat datasets, ties, a phrase often in one text only, a null dataset, too few phrases.
    texts = [(i, "steep", " ".join(draw.choices(words, [3 ** -k for k in range(25)], k=12))) for i in range(80)]
    texts += [(i, "flat", " ".join(draw.choices(words, k=12))) for i in range(80)]
    texts += [(9, "flat", "zorb zorb " * 40), (9, None, "zorb karn zorb"), (None, None, "zorb karn"), (7, "few", "one"), (8, "none", None)]
    table = spark.createDataFrame(texts, "doc long, dataset string, text string")
    monkeypatch.setattr(P, "SLOTS", slots)
    monkeypatch.setattr(P, "FIRST_SLOTS", first)
    texts = [(i, d, None if t is None else t.replace("one", "")) for i, d, t in texts]
    for top in (1, 10):
        got = [(r["dataset"], r["phrase"], r["n"], r["rank"]) for r in frequent_phrases(table, "doc", top=top).collect()]
        assert sorted(got, key=lambda row: tuple(map(repr, row))) == _top_phrases(texts, top)


def test_few_phrases_are_counted_one_by_one(spark, monkeypatch):
    texts = spark.range(2000).select(
        F.col("id").alias("doc"), F.lit("d").alias("dataset"),
        F.concat(F.lit("alpha beta "), F.translate(F.col("id").cast("string"), "0123456789", "bcdfghjkln"), F.lit("q gamma")).alias("text"),
    )
    monkeypatch.setattr(P, "FIRST_SLOTS", 4)
    seen, counted = [], P._counted

    def spied(found, chosen, *rest):
        seen.append(chosen.count())
        return counted(found, chosen, *rest)

    monkeypatch.setattr(P, "_counted", spied)
    assert [(r["phrase"], r["n"]) for r in frequent_phrases(texts, "doc", top=1).collect()] == [("alpha beta", 2000)]
    assert seen and seen[0] < 100 and len(seen) == 1


def test_phrases_move_once(spark, monkeypatch):
    # Repeated and null ids, a null dataset, a null text; far more buckets than phrases in a text.
    texts = [
        (1, "d", "alpha beta gamma alpha beta gamma"), (1, "d", "beta gamma alpha"), (None, "e", "alpha beta delta"),
        (2, "e", None), (3, None, "delta alpha beta"), (4, "e", "omega sigma"), (5, "e", "alpha beta regulationroom"),
    ]
    table = spark.createDataFrame(texts, "doc long, dataset string, text string")
    monkeypatch.setattr(P, "BUCKET_CHARS", 10)
    phrases = []
    for doc, dataset, text in texts:
        words = (text or "").replace("regulationroom", "regulation room").split()
        phrases.append((doc, dataset, Counter(" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1))))
    df = Counter(p for _, _, found in phrases for p in found)
    weights = [
        (doc, dataset, p, n * (math.log(8 / (1 + df[p])) + 1)) for doc, dataset, found in phrases for p, n in found.items() if df[p] > 1
    ]
    squares = Counter()
    for doc, _, _, w in weights:
        squares[doc] += w * w
    order = lambda row: tuple(map(repr, row))
    want = sorted(((doc, ds, p, round(w / math.sqrt(squares[doc]), 9)) for doc, ds, p, w in weights), key=order)
    assert sorted(((*r[:3], round(r[3], 9)) for r in tfidf(table, "doc").collect()), key=order) == want
    # The one exchange of phrases is read by frequencies, norms and weights; the others hold numbers.
    with pinned(spark, P.BY_BUCKET):
        rows = P._weighted(table, "doc", "dataset", 2, ())
        rows.collect()
        final = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [line for line in final.splitlines() if "Exchange hashpartitioning(" in line and "Reused" not in line]
    assert len(moved) == 4 and final.count("ReusedExchange") >= 2
    assert len([line for line in moved if "REPARTITION_BY_NUM" in line]) == 3


def test_texts_of_a_deal_share_their_cells(spark, monkeypatch):
    draw, words = random.Random(3), [a + b + "q" for a in "bcdfg" for b in "klmnp"]
    texts = [(i, "ab"[i % 2], " ".join(draw.choices(words, k=40))) for i in range(1500)]
    table = spark.createDataFrame(texts, "doc long, dataset string, text string")
    monkeypatch.setattr(P, "BUCKET_CHARS", sum(len(t) for _, _, t in texts) // 12)
    seen, bucketed = [], P._bucketed

    def spied(terms, doc, dataset, buckets):
        seen.append((buckets, bucketed(terms, doc, dataset, buckets)))
        return seen[0][1]

    monkeypatch.setattr(P, "_bucketed", spied)
    assert tfidf(table, "doc").select("doc").distinct().count() == 1500
    buckets, cells = seen[0]
    assert 12 <= buckets <= 13
    # A row per text and bucket would be 1500 * 12 of them.
    assert cells.count() <= 2 * buckets * buckets * P.DEALS


def test_a_triple_stands_for_its_pair(spark):
    draw, words = random.Random(4), [a + b + "q" for a in "bcd" for b in "kl"]
    # Pairs at the end, in several triples, in one triple twice; texts of two words.
    texts = [(i, "d", " ".join(draw.choices(words, k=draw.randrange(2, 14)))) for i in range(60)]
    table = spark.createDataFrame(texts, "doc long, dataset string, text string")
    found = [Counter(" ".join(t.split()[i : i + n]) for n in (2, 3) for i in range(len(t.split()) - n + 1)) for _, _, t in texts]
    df = Counter(p for one in found for p in one)
    want = {}
    for doc, one in enumerate(found):
        w = {p: n * (math.log(61 / (1 + df[p])) + 1) for p, n in one.items() if df[p] > 1}
        want |= {(doc, p): x / math.sqrt(sum(y * y for y in w.values())) for p, x in w.items()}
    got = tfidf(table, "doc").collect()
    assert len(got) == len(want)
    assert {(r["doc"], r["phrase"]): r["tfidf"] for r in got} == pytest.approx(want)
    rows = document_phrases(table, "doc", deal=F.lit(0)).collect()
    assert len(rows) + sum(r["pair"] for r in rows) == sum(map(len, found)) and len(rows) < 0.75 * sum(map(len, found))


def test_ids_of_any_characters_keep_their_phrases(spark):
    ids = ["a\tb", "a\nb", "a\x1ab", "a\x1aab", "a\x1abb", "\x1ac", "", " ", "=", "\t", "\n\n", "\x1a", None]
    texts = [(i, "d\n\t", f"alpha beta alpha beta omega{'bcdfghjklmnpq'[at]}x") for at, i in enumerate(ids)]
    table = spark.createDataFrame(texts, "doc string, dataset string, text string")
    got = [tuple(r) for r in tfidf(table, "doc").select("doc", "dataset", "phrase").collect()]
    phrases = ["alpha beta", "beta alpha", "alpha beta alpha", "beta alpha beta"]
    assert sorted(got, key=repr) == sorted([(i, "d\n\t", p) for i in ids for p in phrases], key=repr)


def test_bootstrap_interval_covers_the_mean(spark):
    rows = spark.range(400).select(
        F.lit("d").alias("dataset"), F.col("id").cast("string").alias("conv_id"),
        (F.col("id") % 10).cast("double").alias("x"),
    )
    row = T.bootstrap_interval(rows, "x", ["conv_id"], replicates=400).first()
    # Standard error of the mean: sqrt(8.25 / 400) = 0.1436.
    assert row["mean_pct"] == pytest.approx(4.5)
    assert row["ci_low"] == pytest.approx(4.5 - 0.2815, abs=0.06)
    assert row["ci_high"] == pytest.approx(4.5 + 0.2815, abs=0.06)


def test_bootstrap_of_counted_rows(spark):
    # One key holds nearly all rows; equal rows are one draw of their number.
    rows = spark.range(300_000).select(
        F.when(F.col("id") < 30, "small").otherwise("hot").alias("dataset"),
        (F.col("id") % 10).alias("kind"), (F.col("id") % 10).cast("double").alias("x"),
    )
    odd = spark.createDataFrame([("empty", 1, None), (None, 2, 5.0), (None, 3, None)], "dataset string, kind long, x double")
    got = {r["dataset"]: r for r in T.bootstrap_interval(rows.union(odd), "x", ["dataset", "kind"]).collect()}
    error = math.sqrt(8.25 / 299_970)
    assert got["hot"]["mean_pct"] == pytest.approx(4.5)
    assert got["hot"]["ci_low"] == pytest.approx(4.5 - 1.96 * error, abs=0.2 * error)
    assert got["hot"]["ci_high"] == pytest.approx(4.5 + 1.96 * error, abs=0.2 * error)
    assert got["small"]["ci_high"] - got["small"]["ci_low"] == pytest.approx(2 * 1.96 * math.sqrt(8.25 / 30), rel=0.15)
    assert got["empty"]["mean_pct"] is None and got["empty"]["ci_low"] is None
    assert got[None]["mean_pct"] == 5.0 and got[None]["ci_high"] == 5.0
    assert T.bootstrap_interval(rows.limit(0), "x", ["dataset", "kind"]).count() == 0


def test_histogram_closes_the_last_bin_and_integrates_to_one(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 10), ("a", 10), ("b", 5)], "dataset string, v int")
    got = T.density_histogram(rows, F.col("v"), 5).collect()
    assert {(r["dataset"], r["bin"], r["n"]) for r in got} == {("a", 0, 1), ("a", 4, 2), ("b", 2, 1)}
    assert sum(r["density"] * 2 for r in got if r["dataset"] == "a") == pytest.approx(1)


def test_chunks_over_slices(spark):
    rows = [("c", t * 3, f"t{t}") for t in range(14)]
    table = spark.createDataFrame(rows, "conv_id string, turn long, text string")
    got = C.chunks(table).orderBy("chunk").collect()
    assert [r["discussion"].split("\n")[0] for r in got] == ["t0", "t6"]


def test_polarity_and_merge(spark):
    rows = spark.createDataFrame(
        [("CeRI", "Welcoming"), ("WHoW", "Instruction"), ("Fora", "Model examples"), ("Fora", "?")],
        "taxonomy string, tactic string",
    )
    assert [r["polarity"] for r in C.tactic_polarity(rows).collect()] == ["positive", "negative", "none", None]


def test_category_order(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    assert [r["k"] for r in B.in_category_order(rows, "k", ["c", "a"]).collect()] == ["c", "a", "b", "d"]


def test_spread_is_the_inverse_of_melt(spark):
    rows = spark.createDataFrame([("i", 1.0, 2.0)], "k string, x double, y double")
    long = B.melt(rows, ["k"], ["x", "y"], "name", "value")
    assert B.spread(long, ["k"], "name", "value", ["x", "y"]).first().asDict() == rows.first().asDict()


def test_observed_counters(spark, sf):
    from pyspark.sql import Observation

    # The same counters reach a listener while another action runs.
    rows = V.survey_responses(spark, sf)
    seen = Observation("seen")
    bad = ~F.col("single_response_text").rlike("[0-9]")
    rows.observe(seen, F.count_if(bad).alias("bad")).write.format("noop").mode("overwrite").save()
    assert seen.get["bad"] == T.quality_counters(rows, bad=bad).first()["bad"]
    assert T.observed(rows, "quality", bad=bad).count() == rows.count()


def test_unknown_labels_raise_before_a_job(spark):
    rows = spark.createDataFrame([(True,)], "is_moderator boolean")
    with pytest.raises(KeyError):
        C.label_columns(rows, ["is_moderator", "nothing"])
    assert rows.select(C.label_columns(rows, "is_moderator")["is_moderator"]).first()[0] == 1.0
    assert C.in_training_group(spark.createDataFrame([("iq2",), ("ceri",)], "dataset string"), "spoken").count() == 1


def test_a_trained_head_scores_in_a_session_with_observations(spark):
    from pyspark.sql import Observation

    from parley.operators.scoring import feature_rows, log_loss, score_rows, train_head

    rows = spark.range(400).select(
        "id", F.array((F.col("id") % 7).cast("double"), F.pmod(F.hash("id"), F.lit(5)).cast("double")).alias("x")
    )
    rows.observe(Observation("n"), F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    table = feature_rows(rows, "x", F.col("x")[0] > 4)
    model, split = train_head(table.select("id", "features", "label"), "id", penalties=(0.0, 1.0))
    scored = score_rows(model, split.where("split = 'test'"))
    # The weaker penalty separates the classes and wins on validation loss.
    assert log_loss(scored).first()["loss"] < 0.1
    assert scored.where("decision <> label").count() == 0


def test_heads_of_all_penalties_reach_the_minimum(spark, tmp_path):
    import numpy as np

    from parley.operators.head import Head, fit_heads

    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6)) @ (np.eye(6) + 0.3 * rng.normal(size=(6, 6))) + 5.0
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] - 1.5)))).astype(float)
    odd = [(None, 1.0), ([1.0] * 5, 1.0), ([float("nan")] * 6, 0.0), ([None] + [1.0] * 5, 0.0), ([1.0] * 6, None)]
    rows = [(r.tolist(), float(label)) for r, label in zip(x, y)] + odd
    train = spark.createDataFrame(rows, "features array<double>, label double")
    heads = fit_heads(train, (0.01, 0.1), steps=200)
    scale = x.std(axis=0)
    z = np.hstack([(x - x.mean(axis=0)) / scale, np.ones((600, 1))])
    c = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    c /= c.sum()
    for penalty, head in zip((0.01, 0.1), heads):
        # Newton's method on all rows at once.
        w, free = np.zeros(7), np.append(np.full(6, penalty), 0.0)
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve(z.T @ ((c * p * (1 - p))[:, None] * z) + np.diag(free), z.T @ (c * (p - y)) + free * w)
        assert head.weights == pytest.approx(w[:-1] / scale, abs=1e-5)
        assert head.bias == pytest.approx(w[-1] - (w[:-1] / scale) @ x.mean(axis=0), abs=1e-4)
    heads[0].save(spark, f"{tmp_path}/head")
    assert Head.load(spark, f"{tmp_path}/head") == heads[0]
    with pytest.raises(ValueError):
        fit_heads(train.limit(0), (0.0,))


def test_a_head_of_one_class_and_of_a_constant_feature(spark):
    from parley.operators.head import fit_heads

    rows = [([float(i), 3.0], 1.0) for i in range(20)]
    train = spark.createDataFrame(rows, "features array<double>, label double")
    head = fit_heads(train, (0.1,))[0]
    assert head.weights[1] == 0 and head.bias > 1


def test_surviving_groups_of_landed_rows(spark, monkeypatch):
    rows = [("a", 1), ("a", 1), ("", 2), (None, 3), ("g", 4), ("x/y=z", 5)]
    table = spark.createDataFrame(rows, "dataset string, x int")
    groups = spark.createDataFrame([("a",), ("",), ("a",), (None,), ("x/y=z",), ("new",)], "dataset string")
    want = [("", 2), ("a", 1), ("a", 1), ("x/y=z", 5)]
    for bound in (100, 1):
        monkeypatch.setattr(T, "BROADCAST_GROUPS", bound)
        got = T.surviving_groups(T.landed_groups(table), groups)
        assert got.columns == ["dataset", "x"] and sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, T.surviving_groups(table, groups).collect())) == want
    assert T.surviving_groups(T.landed_groups(table.limit(0)), groups).count() == 0
