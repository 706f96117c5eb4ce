"""What a Python worker still holds after a batch, and how many rows of one are objects at once."""

import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import near_copies, simhash

HELD = """
import random, re
import pyarrow as pa
from pyspark.sql import functions as F
F.arrow_udf = lambda kind: lambda f: lambda column: f
from parley.llm import bpe
from parley.llm.queries import vocabulary_path

def held():
    text = open("/proc/self/smaps_rollup").read()
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", text))) >> 10

encode, rnd = bpe.encode("text", vocabulary_path()), random.Random(1)
words = ["".join(rnd.choices("abcdefghi", k=rnd.randint(3, 9))) for _ in range(5_000)]
make = lambda: pa.array([" ".join(rnd.choices(words, k=250)) for _ in range(10_000)])
n = sum(map(len, encode(iter([pa.array(["one"])]))))
before = held()
n += sum(map(len, encode(make() for _ in range(2))))
print(n, held() - before)
"""


def test_a_worker_hands_back_what_a_batch_took():
    done = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, timeout=120)
    n, more = map(int, done.stdout.split())
    assert n == 20_001
    assert more < 60  # MB; batches of 16 MB


@pytest.mark.parametrize("n", [0, 1, 1_300])
def test_sketches_leave_in_slices(monkeypatch, n):
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: lambda column: f)
    texts = [None if i % 97 == 5 else f"text {i % 11} of a few words and no more {i % 7}" for i in range(n)]
    parts = list(near_copies._sketches("text", 5)(iter([pa.array(texts, pa.string())] * 2)))
    assert all(len(x) <= 512 for x in parts)
    own = [dict(zip(("keys", "bits", "n"), near_copies.sketch(t)), fp=simhash.fingerprint(t, 5)) for t in texts]
    assert [x for part in parts for x in part.to_pylist()] == own * 2
