"""Compression bands: plain rules against a brute-force version, bands on planted texts, odd rows."""

import base64
import random
from collections import Counter

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import words
from pyspark.sql import functions as F

from parley.llm import compression

PROSE = "alpha river stone walks under bright morning clouds while seven quiet birds cross the old wooden bridge".split()


def brute(text):
    text = text or ""
    found = words(text)
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    covered = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered))


def measured(text):
    return compression.measure(text, zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "é", "#", "<x>", " ", "\n", "\t", "\x0b", " ", "\x1c"]), max_size=80))
def test_counts_equal_brute_force(parts):
    for text in ("".join(parts), " ".join(parts)):
        assert measured(text)[:5] == brute(text)


def prose(n, seed=0):
    rng = random.Random(seed)
    made = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    return " ".join(rng.choice(made) for _ in range(n))


def blob(n, seed=1):
    return base64.b64encode(random.Random(seed).randbytes(n)).decode()


TEXTS = {
    1: (prose(60), True), 2: (prose(400), True), 3: (prose(20_000), True),
    4: ("repeat this very line again and again my friend \n" * 300, False),
    5: (" ".join(blob(60, i) for i in range(60)), False),
    6: (prose(3_000) + " " + " ".join(blob(90, i) for i in range(200)), False),
    7: (prose(3_000) + " " + "ab " * 9_000, False),
    8: (prose(20_000) + " " + " ".join(blob(90, i) for i in range(20)), True),
    9: (None, False), 10: ("", False), 11: ("too short", False), 12: ("é日本 " + prose(300), True),
}


def test_bands_reject_repetition_and_noise(spark):
    rows = [(i, t, 0.5, True) for i, (t, _) in TEXTS.items()] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ratio double, kept boolean")
    m = df.select("doc_id", "text", compression.measures(F.col("text")).alias("m"))
    got = m.select(
        "doc_id", "text", "m", compression.base_failed(F.col("m")).alias("failed"),
        compression.within_bands(F.col("m")).alias("within"),
    ).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        assert tuple(r["m"])[:5] == brute(r["text"])
        n, again = r["m"]["n_words"], r["m"]["n_repeat_words"]
        assert r["failed"] == (n < 50 or 100 * again > 50 * n)
        assert (not r["failed"] and r["within"]) == TEXTS[r["doc_id"]][1], r["doc_id"]
    # The bands decide alone where the plain rules see nothing.
    alone = {r["doc_id"]: (r["failed"], r["within"]) for r in got}
    assert alone[5] == (False, False) and alone[6] == (False, False)
    assert m.limit(0).collect() == []


def test_columns_decide_as_the_bands_do(spark):
    bands = compression.BANDS
    cases = [(n, r) for n in (0, 63, 64, 255, 4_095, 4_096, 10**6) for r in (0.0, 0.9, 1.2, 1.4, 4.2, 5.2, 7.0)]
    df = spark.createDataFrame([((0, n, r, 0.0),) for n, r in cases], "m struct<n_words:long,n_bytes:long,ratio:double,odd_share:double>")
    got = [r[0] for r in df.select(compression.within_bands(F.col("m"))).collect()]
    import numpy as np

    assert got == bands.holds(np.array([n for n, _ in cases]), np.array([r for _, r in cases])).tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_few_words(n):
    assert compression.repeat_words(["a"] * n) == (0 if n < 4 else 4)
