"""The manifest against a tree built by hand, tampering, and odd rows."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.llm import merkle
from parley.llm.shared import id_remainder

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, leaf int, part string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def climb(tree, at, value, siblings):
    for level in tree[:-1]:
        run, own = level[at // 3 * 3 : at // 3 * 3 + 3], at % 3
        siblings += run[:own] + run[own + 1 :]
        value, at = H(*run[:own], value, *run[own + 1 :]), at // 3
    return value


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf(*r[:5]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in groups[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for rank, s in enumerate(order):
        for i, (doc_id, own, r) in enumerate(groups[s]):
            text = r[4]
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            siblings = []
            folded = climb(trees[s], i, leaf(*r[:4], text), siblings)
            folded = climb(top, rank, folded, siblings)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], H(*siblings), folded, folded == top[-1][0]))
    return out


def proved(spark, rows):
    df = spark.createDataFrame([(*r, "h", 1, "p") for r in rows], SCHEMA).repartition(3)
    flat = {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    return merkle.verified(merkle.build(df, tampered=flat, tampered_where=id_remainder("doc_id", 2) == 0))


CASES = {
    "one row": [(1, "a", "en", 3, "x\ny")],
    "one group": [(i, "a", None, i, f"t\n{i}") for i in range(40)],
    "single rows": [(i, f"s{i:03}", "en", None, f"\n{i}") for i in range(35)],
    "odd": [
        (5, None, None, None, None), (None, None, "en", 1, "no\nid"), (6, "", "en", 0, ""), (7, "é", "fr", 9, "é\n日本"),
        (8, "z", "en", 1, "a\nb"), (8, "z", "en", 1, "a\nb"), (8, "z", "en", 1, "other\n"), (9, "Z", "en", 1, "long\n" * 30_000),
        (2**62, "z", "en", 1, "\n"), (-4, "z", "en", 1, "\n"),
    ],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_a_tree_by_hand(spark, name):
    assert Counter(map(tuple, proved(spark, CASES[name]).collect())) == Counter(brute(CASES[name]))


def test_a_hot_group_spans_chunks(spark):
    rows = [(i, "hot" if i % 4 else f"s{i % 52}", "en", i, f"text\n{i}") for i in range(2_300)]
    got = proved(spark, rows).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))
    broken = {r["id"] for r in got if not r["verified"]}
    assert broken == {i for i in range(2_300) if zlib.crc32(str(i).encode()) % 2 == 0}


def test_untouched_rows_all_verify_and_no_key_is_large(spark):
    rows = [(i, "a", "en", 1, f"{i}") for i in range(1_600)]
    tree = merkle.build(spark.createDataFrame([(*r, "h", 1, "p") for r in rows], SCHEMA))
    assert merkle.verified(tree).where("verified").count() == 1_600
    assert tree.leaves.groupBy("chunk").count().agg(F.max("count")).first()[0] <= merkle.CHUNK
    assert tree.nodes.groupBy("chunk", "node").count().where("count > 1").count() == 0


def test_an_empty_table_has_no_rows(spark):
    assert proved(spark, []).collect() == []


def test_the_row_limit_is_put_back(spark):
    spark.conf.set(merkle._ROW_LIMIT, "77")
    proved(spark, CASES["one group"]).collect()
    assert spark.conf.get(merkle._ROW_LIMIT) == "77"
    spark.conf.unset(merkle._ROW_LIMIT)
