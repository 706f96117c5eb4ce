"""SimHash groups, MinHash fingerprints and exact search against brute force."""

import hashlib
import math
import random
import sys

import numpy as np
import pytest
import xxhash
from plain import near_roots, shingle_set, words
from pyspark.sql import functions as F

from parley.llm import mixing, near_copies, oph, queries, shared, simhash, topk
from parley.llm.components import components


def plain_fingerprint(text):
    found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(text)]
    if not found:
        return 0
    hashes = [
        xxhash.xxh64_intdigest(" ".join(found[i : i + 4]).encode(), seed=42) for i in range(max(1, len(found) - 3))
    ]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def groups_by_hand(values):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                root[find(a)] = find(b)
    return find


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b c", "a b c d", "The the THE é ÉÀ " * 9, "w " * 70_000])
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("dense", [4_096, 2])
def test_groups_equal_brute_force(spark, sf, dense):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    find = groups_by_hand(set(prints.values()))
    smallest = {}
    for d, f in prints.items():
        smallest[find(f)] = min(smallest.get(find(f), d), d)
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.groups(docs, dense=dense).collect()}
    assert got == {d: (f, smallest[find(f)]) for d, f in prints.items()}


@pytest.mark.parametrize("dense", [4_096, 4, 1])
def test_no_link_is_lost_in_dense_groups(spark, dense):
    rnd = random.Random(3)
    values = set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rnd.randrange(9)):
                x ^= 1 << rnd.randrange(64)
            values.add(simhash._signed(x))
    find, want, got = groups_by_hand(values), {}, {}
    for v in values:
        want.setdefault(find(v), set()).add(v)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for r in components(simhash.links(df, 4, dense)).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert got == {min(v): v for v in want.values() if len(v) > 1}


def test_awkward_documents_have_groups(spark, small):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.groups(small).collect()}
    assert {(2, 2), (3, 2), (4, 2), (1, 1), (None, None), (6, 6)} <= got
    kept = simhash.keep_first(small)
    assert kept.columns == small.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in got if c is not None})
    assert ids.count(None) == 1
    assert simhash.groups(small.limit(0)).count() == 0


@pytest.mark.parametrize("one_of_each", [simhash.keep_first, near_copies.drop])
def test_each_group_keeps_one_row(spark, one_of_each):
    rows = [
        (None, "a b c d e f g"), (None, "p q r s t u v"), (None, "a b c d e f g"), (1, "h i j k l m"), (1, "n o p q r s"),
        (1, "h i j k l m"), (2, "n o p q r s"), (3, None), (4, " "), (None, "h i j k l m"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, one_of_each(df).collect()), key=str)
    want = [(None, "a b c d e f g"), (None, "p q r s t u v"), (1, "h i j k l m"), (1, "n o p q r s"), (3, None)]
    assert got == sorted(want, key=str)


def variants(rnd, base, edits):
    """A text with single words replaced."""
    words = list(base)
    for at in rnd.sample(range(len(base)), edits):
        words[at] = f"x{rnd.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_equal_brute_force(spark):
    rnd = random.Random(5)
    texts = []
    for _ in range(8):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(40, 200))]
        for _ in range(8):
            at = rnd.randrange(len(base))
            cut = rnd.randrange(len(base) // 6)
            texts.append(" ".join(base[:at] + [f"x{rnd.randrange(10**6)}"] + base[at + cut :]))
    root = near_roots(texts)
    assert 8 < len(set(root)) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.drop(df).collect()} == set(root)


# Edits of 160 words: similarity to the base about 0.88, 0.82, 0.77, 0.70.
@pytest.mark.parametrize("edits", [2, 3, 4, 6, "mixed"])
def test_large_groups_equal_brute_force_with_few_pairs(spark, monkeypatch, edits):
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(160)]
    n = 240
    texts = [" ".join(base)] + [variants(rnd, base, rnd.choice([1, 2, 3, 4, 6, 9]) if edits == "mixed" else edits) for _ in range(n)]
    read = []
    plain = near_copies._alike

    def watched(pairs, sets, similarity):
        read.append(pairs.count())
        return plain(pairs, sets, similarity)

    monkeypatch.setattr(near_copies, "_alike", watched)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.drop(df).collect()} == set(near_roots(texts))
    # Sets are read for a few pairs a text, not for all pairs of the group.
    assert sum(read) < 12 * n


def test_near_copies_take_groups_of_simhash(spark, monkeypatch):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    base = [" ".join(draw.choices(words, k=300)) for _ in range(3)]
    # One word less at the end: a fingerprint a few bits away at most, and still alike; the third text has no copy.
    texts = [base[0], base[0] + " end", base[1], base[1].rsplit(" ", 1)[0], base[2]]
    assert all((simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[i + 1], 5)).bit_count() <= 4 for i in (0, 2))
    # Without a key of MinHash the groups of SimHash are all there is; the sets still decide.
    monkeypatch.setattr(near_copies, "_sketches", keyless(near_copies._sketches))
    df = spark.createDataFrame(list(enumerate([*texts, "a b c d e", "", None])), "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.drop(df).collect()} == {0, 2, 4, 5, 6}


def keyless(sketches):
    return lambda text, words: sketches(text, words).withField("keys", F.array().cast("array<long>"))


def test_bitmaps_never_drop_a_link():
    rnd = random.Random(2)
    for size in (3, 40, 400, 4_000):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
        one, two = " ".join(base), variants(rnd, base, min(size, rnd.randrange(1, 9)))
        (_, bits_a, n_a), (_, bits_b, n_b) = near_copies.sketch(one), near_copies.sketch(two)
        differ = sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) + (1 << 64)).bit_count() for x, y in zip(bits_a, bits_b))
        a, b = shingle_set(one), shingle_set(two)
        assert (n_a, n_b) == (len(a), len(b)) and differ <= len(a ^ b)


def test_columns_of_any_name_pass_through(spark):
    names = ["doc_id", "text", "_id", "_none", "_unit", "id", "none", "unit", "row", "keys", "set", "a"]
    df = spark.createDataFrame([(1, "a b c d e f", *range(10)), (2, "a b c d e f", *range(10)), (3, "other", *range(10))],
                               ", ".join(f"{c} {'string' if c == 'text' else 'long'}" for c in names))
    for one_of_each in (simhash.keep_first, near_copies.drop):
        got = one_of_each(df)
        assert got.columns == names
        assert sorted(tuple(r)[0] for r in got.collect()) == [1, 3]
        assert {tuple(r)[2:] for r in got.collect()} == {tuple(range(10))}


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def shingles(text):
    found = words(text)
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_is_close_to_the_share_of_shingles(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in queries.op4_oph_fingerprints(spark, sf).collect()}
    assert len(got) == len(rows)
    errors = []
    for this, after in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(this["text"]) // 2
        edited = this["text"][: len(this["text"]) - half] + after["text"][:half]
        r = got[this["doc_id"]]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["n_chars"] == len(this["text"]) and len(r["fingerprint"]) == 256
        errors += [r["near_edited"] - likeness(this["text"], edited), r["near_next"] - likeness(this["text"], after["text"])]
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.04


def test_fingerprints_of_awkward_texts(spark, small):
    rows = oph.with_next(small).withColumn("same", oph.likeness(F.col("packed"), F.col("packed")))
    got = rows.select("doc_id", "text", "next_text", oph.hex_string(F.col("packed")).alias("h"), "same").collect()
    assert len(got) == 11 and all(r["same"] == 1.0 for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"], r["h"]) == r["h"]
    assert by_text[""] == by_text[" \t\n\x0b "] == "" and len(by_text["one"]) == 256
    follows = {r["doc_id"]: r["next_text"] for r in got if r["doc_id"] not in (1,)}
    assert follows[9] == "a text without an id" and follows[2] == "" and follows[4] == "one"
    mixed = oph.likeness(F.col("packed"), F.lit(None).cast("array<bigint>"))
    assert {r["text"]: r["m"] for r in rows.select("text", mixed.alias("m")).collect()}["one"] == 0.0
    assert oph.with_next(small.limit(0)).count() == 0
    one = oph.with_next(small.where("doc_id = 5")).first()
    assert one["next_text"] == "one"


def test_slices_do_not_change_neighbours(spark, small, monkeypatch):
    monkeypatch.setattr(oph, "ROWS_PER_SLICE", 1)
    several = {(r["doc_id"], r["text"], r["next_text"]) for r in oph.with_next(small).collect()}
    monkeypatch.undo()
    assert several == {(r["doc_id"], r["text"], r["next_text"]) for r in oph.with_next(small).collect()}


def test_exact_search_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_SHARD", 7)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    rows = [(i % 9, [float((i * j) % 5 - 2) / 64 * (1 if i < 30 else 2.0**40) for j in range(4 if i % 7 else 3)]) for i in range(40)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (5, None), (6, [1.0, None, 2.0, 1.0]), (7, [math.nan] * 4), (8, [math.inf] * 4), (0, []), (3, [])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, shard string")
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 3 == 0, k=5).collect()), key=str)
    usable = [
        (i, [math.floor(64 * x) for x in v], n) for n, (i, v) in enumerate(rows)
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    top, want = (1 << 63) - 1, []
    for i, v, n in usable:
        if i is None or i % 3:
            continue
        scored = sorted(
            (-max(-top, min(top, sum(a * b for a, b in zip(v, w, strict=True)))), top if j is None else j)
            for j, w, m in usable if m != n and len(w) == len(v)
        )[:5]
        want += [(i, rank + 1, None if j == top else j, -s) for rank, (s, j) in enumerate(scored)]
    assert got == sorted(want, key=str)
    assert topk.search(df.limit(0), F.lit(True)).count() == 0


def test_products_are_exact_beyond_floats():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 40), 1 << 40, (3, 5)), rng.integers(-(1 << 20), 1 << 20, (4, 5))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert topk.exact_scores(a, b).tolist() == np.clip(np.array(want, object), -topk._LONG, topk._LONG).tolist()


@pytest.mark.parametrize("operator", [simhash.groups, simhash.keep_first, near_copies.drop])
def test_no_side_that_grows_with_the_documents_is_broadcast(spark, monkeypatch, operator):
    # Small files: Spark takes every side of these joins, exploded keys included, for one to broadcast.
    rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(60)) + f" end{i % 13}") for i in range(120)]
    docs = shared.landed(spark.createDataFrame(rows, "doc_id long, text string"), "no-broadcast")
    plans = []

    def planned(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return shared.landed(df, name)

    for module in (simhash, near_copies, sys.modules[components.__module__]):
        monkeypatch.setattr(module, "landed", planned)
    plans.append(("result", operator(docs)._jdf.queryExecution().executedPlan().toString()))
    assert sum("SortMergeJoin" in text for _, text in plans) >= 5
    assert [name for name, text in plans if "Broadcast" in text] == []


def test_blocks_of_the_mixture_are_not_broadcast(spark):
    rows = [(i, "ab"[i % 2], "w " * (i % 300)) for i in range(60)]
    docs = shared.landed(spark.createDataFrame(rows, "doc_id long, source string, text string"), "no-broadcast")
    plan = mixing.mix(docs)
    for df in (mixing.taken_words(plan), mixing.mixed_texts(docs, plan)):
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
        # The innermost join is that of the blocks; the list of the sources is small.
        assert "SortMergeJoin" in joins[-1]
