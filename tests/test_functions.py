"""Literal rows for every edge case of the expressions."""

import math

import pytest
from pyspark.sql import functions as F

from parley.functions import labels as L
from parley.functions import parsing as P
from parley.functions import text as X
from parley.functions.hashing import (
    hash_order,
    hash_uniform,
    hash_word,
    poisson_draw,
    poisson_one_cdf,
    poisson_weight,
)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def text(v):
    return F.lit(v).cast("string")


def test_blanks_are_every_python_blank():
    blanks = {chr(c) for c in range(0x3001) if chr(c).isspace()}
    assert set(X.BLANKS) == blanks
    assert len(X.BLANKS) == len(blanks)


@pytest.mark.parametrize(
    "given, expected",
    [
        ("short ", "short "),
        ("x" * 2999 + "\n" + "y", "x" * 2999),
        ("x" * 3000, "x" * 3000),
        ("x" * 3001, "x" * 3000),
        (None, None),
    ],
)
def test_truncate_comment(spark, given, expected):
    assert value(spark, X.truncate_comment(text(given))) == expected


def test_redact_prompt(spark):
    assert value(spark, X.redact_prompt(text("Moderators moderator MODERATOR"))) == "Xs X MODERATOR"
    assert value(spark, X.redact_prompt(text(None))) == "nan"
    assert value(spark, X.redact_prompt(text("a" * 2995 + "moderator"))) == "a" * 2995 + "moder"


@pytest.mark.parametrize(
    "given, expected",
    [(None, 1), ("", 0), ("  a  b\n\tc ", 3), ("a b c", 3), ("w " * 700, 500)],
)
def test_word_count(spark, given, expected):
    assert value(spark, X.word_count(text(given))) == expected


def test_clean_text(spark):
    raw = "See HTTP://x.y/z?q and www.a.b  it's 2 RegulationRoom's\n\nfine!"
    assert value(spark, X.clean_text(text(raw))) == "see and its regulationrooms fine"
    assert value(spark, X.clean_text(text(raw), X.GLUED_WORDS)) == "see and its regulation rooms fine"
    assert value(spark, X.clean_text(text(None))) == ""


def test_shorten(spark):
    assert value(spark, X.shorten(text("a" * 28))) == "a" * 28
    assert value(spark, X.shorten(text("a" * 29))) == "a" * 27 + "…"


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Positive: 4\nNegative: 2\nNo Reinforcement: 1", (4, 2, 1)),
        ("Positive:  4\nNegative:4", (0, 4, 0)),
        ("POSITIVE: 5 negative:\n3 no reinforcement:   10", (5, 3, 10)),
        ("Positive: 1 Positive: 2", (1, 0, 0)),
        (None, (0, 0, 0)),
        ("no answer", (0, 0, 0)),
    ],
)
def test_parse_dual(spark, given, expected):
    row = spark.range(1).select(*[c.alias(n) for n, c in P.parse_dual(text(given)).items()]).first()
    assert tuple(row) == expected


def test_parse_dual_lenient(spark):
    parsed = P.parse_dual(text("Positive:  4"), lenient=True)
    assert value(spark, parsed["positive_reinforcement"]) == 4


@pytest.mark.parametrize("given, expected", [("I say 3 of 5", 3.0), ("none", None), (None, None), ("2.7", 2.0)])
def test_parse_single(spark, given, expected):
    assert value(spark, P.parse_single(text(given))) == expected


@pytest.mark.parametrize(
    "given, expected",
    [(" Y ", 1), ("1.0", None), ("2", None), (None, None), ("FALSE\n", 0), ("no", 0), ("true", 1)],
)
def test_normalise_binary(spark, given, expected):
    assert value(spark, P.normalise_binary(text(given))) == expected


@pytest.mark.parametrize("given, expected", [(0.7, 0), (1.9, 1), (2.0, None), (-0.5, 0), (None, None)])
def test_normalise_binary_number(spark, given, expected):
    assert value(spark, P.normalise_binary_number(F.lit(given).cast("double"))) == expected


@pytest.mark.parametrize("given, expected", [("4 – strong", 4), (None, 0), ("3", 3)])
def test_rating_prefix(spark, given, expected):
    assert value(spark, P.rating_prefix(text(given))) == expected


def test_malformed_flag(spark):
    assert [value(spark, P.malformed_flag(text(v))) for v in (" yes ", "no", None, "Yes")] == [1.0, 0.0, 0.0, 0.0]


def test_label_rules(spark):
    def both(p, n):
        a, b = F.lit(p).cast("int"), F.lit(n).cast("int")
        return value(spark, L.label_by_presence(a, b)), value(spark, L.label_by_threshold(a, b))

    assert both(1, 0) == (1, 0)
    assert both(3, 5) == (3, 3)
    assert both(0, 4) == (2, 2)
    assert both(None, None) == (0, 0)
    missing = L.label_by_threshold(F.lit(None).cast("int"), F.lit(None).cast("int"), missing="null")
    assert value(spark, missing) is None


def test_label_names(spark):
    assert value(spark, L.label_name(F.lit(3))) == "Both"
    assert value(spark, L.short_label_name(F.lit(2))) == "Neg"
    assert value(spark, L.label_code(F.lit("Positive"))) == 1


def test_decisions_agree_at_the_boundary(spark):
    assert value(spark, L.decide(L.sigmoid(F.lit(0.0)))) == 1
    assert value(spark, L.decide_logit(F.lit(0.0))) == 1
    assert value(spark, L.decide(F.lit(0.49999))) == 0


def test_hashes_are_uniform_and_weights_are_poisson(spark):
    rows = spark.range(20000).withColumn("h", hash_order(42, F.col("id")))
    for word in range(4):
        u, w = hash_uniform(F.col("h"), word), poisson_weight(hash_word(F.col("h"), word))
        steps = [F.when(u >= p, 1).otherwise(0) for p in poisson_one_cdf()]
        assert rows.where(w != sum(steps[1:], steps[0])).count() == 0
        row = rows.select(u.alias("u"), w.alias("w")).agg(
            F.avg("u").alias("u"), F.avg("w").alias("w"), F.var_samp("w").alias("v")
        ).first()
        assert abs(row["u"] - 0.5) < 0.01 and abs(row["w"] - 1) < 0.03 and abs(row["v"] - 1) < 0.06
    assert abs(poisson_one_cdf()[-1] - 1) < 1e-8


def test_poisson_draws_of_any_mean(spark):
    draw = poisson_draw(F.col("n"), hash_word(hash_order(1, F.col("n"), F.col("r"))), lambda t: hash_order(2, F.col("n"), F.col("r"), t))
    means = [1, 3, 9, 10, 17, 1000, 10**7, 10**11]
    table = spark.range(20000).select(F.col("id").alias("r"), F.explode(F.array(*[F.lit(n).cast("long") for n in means])).alias("n"))
    drawn = table.select("n", draw.alias("w"))
    for r in drawn.groupBy("n").agg(F.avg("w").alias("mean"), F.var_samp("w").alias("var")).collect():
        # Standard errors of mean and variance from 20000 draws, five of each.
        assert abs(r["mean"] - r["n"]) < 5 * math.sqrt(r["n"] / 20000)
        assert abs(r["var"] / r["n"] - 1) < 5 * math.sqrt((2 + 1 / r["n"]) / 20000)
    seen = {(r["n"], r["w"]): r["count"] for r in drawn.where("n in (3, 10, 17)").groupBy("n", "w").count().collect()}
    for n in (3, 10, 17):
        # Chi-square over the common values against the probabilities.
        odds = {k: math.exp(k * math.log(n) - n - math.lgamma(k + 1)) * 20000 for k in range(60)}
        common = [k for k in odds if odds[k] >= 10]
        distance = sum((seen.get((n, k), 0) - odds[k]) ** 2 / odds[k] for k in common)
        assert distance < len(common) + 5 * math.sqrt(2 * len(common))


def test_poisson_draw_of_nothing_is_zero(spark):
    table = spark.createDataFrame([(0,), (None,)], "n long")
    draw = poisson_draw(F.col("n"), F.lit("ffffffff"), lambda t: F.lit("f" * 32))
    assert [r[0] for r in table.select(draw).collect()] == [0, 0]
