"""Mixing, dialogues, revisits, the pipeline, and every query with SQL."""

from fractions import Fraction

import duckdb
import pytest
from oracle import compare, connect
from plain import near_roots, words
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import mixing, perspectives, queries, revisits
from parley.llm.shared import bucket_of, id_slicer, landed, order_buckets


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) == []


def targets_by_hand(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, out = set(names), Fraction(sum(sizes.values())), {}
    while left:
        level = total / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > cap * sizes[s]]
        if not over:
            out |= {s: weight[s] * level for s in left}
            break
        for s in over:
            out[s] = Fraction(cap * sizes[s])
            total -= out[s]
            left.discard(s)
    return out


def test_mix_meets_its_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: (r["source"], len(words(r["text"]))) for r in docs.collect()}
    sizes = {}
    for source, n in texts.values():
        sizes[source] = sizes.get(source, 0) + n
    want = targets_by_hand(sizes)
    rows = queries.op5_source_mixing(spark, sf).collect()
    taken = dict.fromkeys(sizes, 0)
    assert len(rows) == len(texts)
    for r in rows:
        assert texts[r["doc_id"]] == (r["source"], r["size"]) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]))
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in sizes)
    again = queries.op5_source_mixing(spark, sf).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_of_awkward_sources(spark):
    sizes = [(1, "a"), (3, "b"), (1_000, "c"), (5, None), (0, "d"), (400, "e"), (2, "f"), (2, "q"), (2, "q")]
    rows = [(i, "w " * n, s, 7) for i, (n, s) in enumerate(sizes)] + [(None, None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    plan = mixing.mix(docs)
    got = mixing.taken_words(plan).collect()
    want = targets_by_hand({"a": 1, "b": 3, "c": 1_000, None: 5, "d": 0, "e": 400, "f": 2, "q": 4})
    assert len(got) == 10
    for r in got:
        assert r["target"] == pytest.approx(float(want[r["source"]]))
        assert r["taken"] <= 3 * r["size"]
    per_epoch = plan.slots.groupBy("source", "epoch").agg(F.count("*").alias("n"), F.countDistinct("block").alias("d"))
    assert per_epoch.where("n <> d").count() == 0
    blocks = {r["source"]: r["blocks"] for r in plan.sources.collect()}
    assert all(0 <= r["block"] < blocks[r["source"]] for r in plan.slots.collect())
    texts = mixing.mixed_texts(docs, plan)
    assert texts.columns == docs.columns
    assert sum(len(words(r["text"])) for r in texts.collect()) == sum(r["taken"] for r in got)
    assert mixing.taken_words(mixing.mix(docs.limit(0))).count() == 0


def test_permutations_are_one_to_one(spark):
    for n in (1, 2, 7, 100, 4_097):
        image = spark.range(n).select(
            mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit(2).cast("long")).alias("x")
        ).collect()
        assert sorted(r["x"] for r in image) == list(range(n))


def dialogue_by_hand(rows):
    """Rows (conv, turn, speaker, text) to the rendered dialogue and counted spans of every perspective."""
    out = {}
    order = sorted(rows, key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in (r[1],)) + ((r[2] is not None, r[2] or ""), r[3] or ""))
    for conv in {r[0] for r in rows}:
        own = [r for r in order if r[0] == conv]
        for me in {r[2] for r in own} - {"system"}:
            text, spans = "", []
            for _, _, speaker, body in own:
                body = body or ""
                if speaker == "system":
                    text += f"<|im_start|>system\n{body}<|im_end|>\n"
                elif speaker == me:
                    text += "<|im_start|>assistant\n"
                    spans.append((len(text), len(text) + len(body) + 10))
                    text += f"{body}<|im_end|>\n"
                else:
                    text += "<|im_start|>user" + (f" name={speaker}" if speaker else "") + f"\n{body}<|im_end|>\n"
            out[conv, me] = text, spans
    return out


def test_every_perspective_of_a_dialogue(spark, monkeypatch):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ana", "Hi"), (1, 2, "bo", "Hello é"), (1, 3, "ana", None), (1, 4, None, "?"),
        (1, None, "cy", "first"), (2, 0, "system", "alone"), (3, 5, "bo", "x"), (3, 5, "bo", "x"), (3, 5, "ana", ""),
        (None, 1, "ana", "no id"), (4, 1, "ana", "y" * 50_000),
    ] + [(5, 10 * t - 300, "ana" if t % 3 else "bo", f"turn {t}") for t in range(60)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn int, role string, text string, start long, name string")
    want = dialogue_by_hand(rows)
    for width in (2_048, 4):
        monkeypatch.setattr(order_buckets, "__defaults__", (width,))
        got = {}
        for r in sorted(perspectives.rotate(df).collect(), key=lambda r: r["start"]):
            text, spans = got.setdefault((r["conv_id"], r["perspective"]), ("", []))
            assert r["start"] == len(text)
            if r["mask_to"] > r["mask_from"]:
                spans.append((r["mask_from"], r["mask_to"]))
            got[r["conv_id"], r["perspective"]] = text + r["rendered"], spans
        assert got == want
    assert perspectives.rotate(df.limit(0)).count() == 0


def resolved_by_hand(rows):
    out = []
    for key, url, ts, kind, headers in rows:
        if kind != "revisit":
            continue
        fresh = {k.lower(): v for k, v in (headers or {}).items() if v is not None}
        earlier = [r for r in rows if r[3] == "response" and url is not None and ts is not None and r[1] == url and r[2] is not None and r[2] < ts]
        if not earlier:
            out.append((key, "no_response", None, None))
            continue
        best = max(earlier, key=lambda r: (r[2], r[0]))
        stored = {k.lower(): v for k, v in (best[4] or {}).items() if v is not None}
        pairs = [(fresh[n].removeprefix("W/"), stored[n].removeprefix("W/")) for n in ("etag", "last-modified") if n in fresh and n in stored]
        status = "unverified" if not pairs else "resolved" if pairs[0][0] == pairs[0][1] else "mismatch"
        merged = {**stored, **{k: v for k, v in fresh.items() if k in revisits.PERMITTED}} if status == "resolved" else None
        out.append((key, status, best[0], merged))
    return out


def test_revisits_equal_brute_force(spark, monkeypatch):
    rows = [
        (1, "http://a/x", 10, "response", {"ETag": "1", "Content-Type": "t", "Date": "d1"}),
        (2, "http://a/x", 10, "revisit", {"ETag": "1"}), (3, "http://a/x", 11, "revisit", {"etag": "W/1", "Date": "d2", "Content-Type": "no"}),
        (4, "http://a/x", 12, "response", {"Last-Modified": "m"}), (5, "http://a/x", 12, "response", None),
        (6, "http://a/x", 13, "revisit", {"Last-Modified": "m"}), (7, "http://a/x", 14, "revisit", None),
        (8, None, 15, "revisit", {"ETag": "1"}), (9, "http://a/x", None, "revisit", {"ETag": "1"}),
        (10, "http://b/", 1, "response", {"ETag": None}), (11, "http://b/", 2, "revisit", {"ETag": "1"}),
        (12, "http://a/x", 11, "request", None), (3, "http://a/x", 11, "revisit", {"etag": "W/1", "Date": "d2", "Content-Type": "no"}),
    ]
    for n in range(60):
        rows.append((100 + n, "http://hot/", n // 2, "response" if n % 7 == 0 else "revisit", {"ETag": str(n // 9)}))
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id long, url string, ts long, kind string, headers map<string,string>, status string")
    for width in (2_048, 5):
        monkeypatch.setattr(order_buckets, "__defaults__", (width,))
        got = [(r["record_id"], r["status"], r["response_id"], r["headers"]) for r in revisits.resolve(df).collect()]
        assert sorted(got, key=str) == sorted(resolved_by_hand(rows), key=str)
    assert revisits.resolve(df.limit(0)).count() == 0


def test_canonical_urls(spark):
    cases = {
        "HTTP://User@Example.COM:80/A?b#c": "http://example.com/A?b", "https://x.org:443": "https://x.org/",
        "https://x.org:8443?q": "https://x.org:8443/?q", " http://a/b ": "http://a/b", "no scheme": "no scheme", None: None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r["u"]: r["c"] for r in df.select("u", revisits.canonical_url(F.col("u")).alias("c")).collect()} == cases


def test_header_names_ignore_case(spark):
    for made, want in (("map('A', '1', 'a', '2', 'B', null)", {"a": "1"}), ("cast(null as map<string,string>)", {})):
        assert spark.range(1).select(revisits.lower_names(F.expr(made)).alias("x")).first()["x"] == want


def test_slices_and_buckets_follow_the_order(spark):
    df = spark.createDataFrame([(i,) for i in (-7, 0, 1, 2, 50, 51, 1 << 62, -(1 << 62), None)], "id long")
    of, _ = id_slicer(df, "id", 2)
    rows = sorted(((r["id"] is not None, r["id"] or 0), r["s"]) for r in df.select("id", of("id").alias("s")).collect())
    assert [s for _, s in rows] == sorted(s for _, s in rows) and rows[0][1] == -1
    grouped = df.withColumn("g", F.lit("x"))
    cut = grouped.join(order_buckets(grouped, "g", "id", 2), F.col("g") == F.col("_group")).withColumn("b", bucket_of("id"))
    rows = sorted((r["id"], r["b"]) for r in cut.where("id is not null").collect())
    assert [b for _, b in rows] == sorted(b for _, b in rows)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    odd = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "12 34 !", "en", "src0", 7)], docs.schema)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_duplicates", "mixture", "tokens"]
    docs = docs.union(odd)
    for name, stage in corpus_pipeline.STAGES:
        kept = landed(stage(spark, docs, sf), f"test-{name}")
        if name != "tokens":
            assert kept.columns == columns
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language":
            assert ids == {r["doc_id"] for r in before.collect()}
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            wrong = [d for d, q in labels.items() if (d in ids) != (q == 1)]
            assert len(wrong) <= 0.05 * len(labels)
        if name == "near_duplicates":
            rows = sorted(docs.select("doc_id", "text").collect())
            roots = near_roots([r["text"] or "" for r in rows])
            assert ids == {rows[i]["doc_id"] for i in set(roots)}
        docs = kept
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_oracles_parse():
    for sql in queries.ORACLES.values():
        assert duckdb.extract_statements(sql)
