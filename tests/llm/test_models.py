"""The line field and the language models: exact inference, gradients, held-out accuracy."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import language, line_crf, queries
from parley.llm.descent import minimise


def labellings(odds, pairs):
    return {
        labels: math.exp(
            sum(o * y for o, y in zip(odds, labels, strict=True)) + sum(pairs[a, b] for a, b in itertools.pairwise(labels))
        )
        for labels in itertools.product((0, 1), repeat=len(odds))
    }


def test_marginals_equal_the_sum_over_all_labellings():
    rng = np.random.default_rng(0)
    for n in (1, 2, 6):
        odds, pairs = rng.normal(size=n) * 3, rng.normal(size=(2, 2)) * 2
        weights = labellings(odds.tolist(), pairs)
        total = sum(weights.values())
        want = [sum(w for y, w in weights.items() if y[t]) / total for t in range(n)]
        assert np.allclose(line_crf.marginals(odds.tolist(), pairs), want)
    assert line_crf.marginals([1e6, -1e6], np.zeros((2, 2)))[0] > 0.99


def test_the_field_learns_from_whole_documents():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 60)
    sizes = rng.integers(1, 9, len(y))
    x = [np.column_stack([rng.normal(label, 0.7, n), np.ones(n)]) for label, n in zip(y, sizes, strict=True)]
    weights, pairs = line_crf.fit_field(x, y)
    assert weights[0] > 0 and pairs[0, 0] + pairs[1, 1] > pairs[0, 1] + pairs[1, 0]
    scores = [np.mean(line_crf.marginals((d @ weights).tolist(), pairs)) for d in x]
    assert np.mean((np.array(scores) > 0.5) == (y == 1)) > 0.9



def test_gradient_of_the_field_is_that_of_its_loss():
    rnd = np.random.default_rng(4)
    x = [rnd.normal(size=(n, 3)) for n in (1, 4, 2, 5, 3)]
    for doc in (None, np.array([0, 1, 1, 2, 2])):
        loss = line_crf.field_loss(x, np.array([0, 1, 1, 0, 0]), doc)
        at = rnd.normal(size=7)
        value, slope = loss(at)
        steps = np.eye(7) * 1e-6
        numeric = [(loss(at + d)[0] - loss(at - d)[0]) / 2e-6 for d in steps]
        assert np.isfinite(value) and np.allclose(slope, numeric, atol=1e-6)


def test_lines_to_learn_from_lie_over_the_whole_text():
    text = "\n".join(f"line {i}" for i in range(10_000))
    runs = line_crf.chosen_runs(text, 10_000, 200)
    assert len(runs) == 10 and all(b - a == 20 for a, b in runs) and runs == sorted(set(runs))
    assert runs[-1][0] > 5_000 and runs == line_crf.chosen_runs(text, 10_000, 200)
    assert line_crf.chosen_runs(None, 1, 200) == [(0, 1)] and line_crf.chosen_runs(text, 9, 4) != []


def test_minimiser_finds_the_minimum_of_a_quadratic():
    a = np.diag([1.0, 10.0, 0.1])
    b = np.array([1.0, -2.0, 3.0])
    found = minimise(lambda x: (x @ a @ x / 2 - b @ x, a @ x - b), np.zeros(3))
    assert np.allclose(found, np.linalg.solve(a, b), atol=1e-3)


def test_line_features_cover_every_line():
    for text in (None, "", "\n", "a\n\nb c c\n", "é" * 9 + "\n\n", "x" * 100_000):
        own, lengths = line_crf.line_features(text)
        lines = (text or "").encode().split(b"\n")
        assert len(own) == len(lines) and lengths.tolist() == [len(x) for x in lines]
        assert np.isfinite(line_crf.with_neighbours(own)).all()


def test_quality_of_held_out_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = queries.op1_line_crf_quality(spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = rows.where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0.0 <= r["score"] <= 1.0 and r["predicted"] == (r["score"] >= 0.3) for r in held)


def test_quality_of_awkward_texts(spark, small):
    labels = spark.createDataFrame([(1, 1), (6, 0), (8, 0), (9, 1), (5, 1), (5, 0), (2, None)], "doc_id long, quality int")
    model = line_crf.fit(small, labels, F.lit(True))
    rows = small.select("text", line_crf.score(F.col("text"), model).alias("s")).collect()
    assert len(rows) == 11 and all(0.0 <= r["s"] <= 1.0 for r in rows)
    one_kind = line_crf.fit(small, labels.where("quality = 1 and doc_id <> 5"), F.lit(True))
    assert one_kind.score("x") == one_kind.score(None) == 1.0
    nothing = line_crf.fit(small.limit(0), labels, F.lit(True))
    assert nothing.score("x") == 1.0


def test_languages_of_held_out_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op8_language(spark, sf).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 150 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)


def test_languages_of_awkward_texts(spark, small):
    model = language.fit(small, F.lit(True))
    assert model.languages == ["de", "en", "es", "fr"]
    rows = small.select("doc_id", "text", language.predict(F.col("text"), model).alias("p")).collect()
    for r in rows:
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["p"]["lang"] != "und") == has_letter and 0.0 <= r["p"]["score"] <= 1.0
    for none in (language.fit(small.limit(0), F.lit(True)), language.fit(small, F.lit(False))):
        assert none.predict("text") == ("und", 0.0)
    single = language.fit(small.where("lang = 'en'"), F.lit(True))
    assert single.predict("text") == ("en", 1.0) and single.predict("12 !") == ("und", 0.0)


def test_texts_of_no_learned_language_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(2)
    noise = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(40))
    odd = ["Быстрая лиса прыгает через ленивую собаку", "我们今天去公园散步", noise, "12 !", None]
    rows = spark.createDataFrame([(10**6 + i, t, "en", "src0", 0) for i, t in enumerate(odd)], docs.schema)
    for own in (docs, docs.where("lang in ('en', 'fr')")):
        kept = corpus_pipeline.identify_language(spark, own.union(rows.withColumn("lang", F.lit(None))), sf)
        assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in own.collect()}


def test_the_sample_is_bounded(spark, small):
    many = small.where("doc_id = 1").select("text", "lang", F.explode(F.sequence(F.lit(1), F.lit(3_000))).alias("doc_id"))
    model = language.fit(many, F.lit(True), per_language=5)
    assert model.languages == ["en"]


def test_families_hold_related_languages():
    assert language.family("en") == language.family("de-AT") == "Germanic"
    assert language.family("fr") == language.family("es") == "Romance"
    assert language.family("xx") == "only xx"
