"""BPE by heap against the library; token shards, the perfect hash, keyed access."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm import bpe, perfect_hash, token_files, vocabulary
from parley.llm.queries import op3_token_files, op10_bpe, vocabulary_path
from parley.llm.vocabulary import Cache

PATH = vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_heap_bpe_equals_the_library(library):
    encoder, decoder = bpe._encoder(PATH), bpe._vocabulary(PATH)
    rnd = random.Random(1)
    odd = "aB '\n\t.,<|>endoftextéΣ́٣½日𝔸İ \x1f\x00ſ　\xa0"
    texts = ["".join(rnd.choice(odd) for _ in range(40)) for _ in range(2_000)]
    texts += ["", " ", "<|endoftext|>a<|startoftext|> b", "<|endoftext", "Don't I'LL 've", "a" * 2_000]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        own = encoder.encode(text)
        assert np.frombuffer(own, "<u4").tolist() == ids, text
        assert decoder.decode(own) == library.decode(ids, skip_special_tokens=False)


def test_encode_and_decode_columns(spark, small, library):
    rows = small.select("text", bpe.encode(F.col("text"), PATH).alias("ids")).withColumn(
        "decoded", bpe.decode(F.col("ids"), PATH)
    ).withColumn("n", bpe.n_ids(F.col("ids"))).collect()
    assert len(rows) == 11
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    both = small.select(bpe.round_trip(F.col("text"), PATH).alias("r")).select("r.*").collect()
    assert sorted((bytes(r["ids"]), r["decoded"]) for r in both) == sorted((bytes(r["ids"]), r["decoded"]) for r in rows)
    assert small.limit(0).select(bpe.encode(F.col("text"), PATH)).count() == 0


def test_a_full_cache_gives_the_same_values():
    cache = Cache(lambda key: key.encode(), 3)
    for _ in range(3):
        for key in "abcdefg":
            assert cache[key] == key.encode()
    assert len(cache) <= 3 and len(cache.older) <= 3


@pytest.mark.parametrize("n", [0, 1, 2, 1_000, 50_000])
def test_perfect_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    levels = perfect_hash.build(keys)
    assert sorted(perfect_hash.slots(levels, keys).tolist()) == list(range(len(keys)))
    blob = perfect_hash.pack(levels, {"fingerprint": perfect_hash.fingerprints(keys)})
    again, columns = perfect_hash.unpack(blob)
    assert (perfect_hash.slots(again, keys) == perfect_hash.slots(levels, keys)).all()
    assert columns["fingerprint"].tolist() == perfect_hash.fingerprints(keys).tolist()


def test_perfect_hash_refuses_repeated_keys():
    with pytest.raises(ValueError):
        perfect_hash.build(np.array([7, 7], np.uint64))


def shards_by_hand(rows, library, end=1):
    """(doc_id, start, n, crc) of rows in ascending order of ids, nulls first."""
    out, start = [], 0
    encoded = [(d, library.encode(t or "", add_special_tokens=False).ids + [end]) for d, t in rows]
    for d, ids in sorted(encoded, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("per_shard", [2, 1_000])
def test_token_files_read_back(spark, small, library, tmp_path, per_shard):
    unique = small.dropDuplicates(["doc_id"])
    written = token_files.write(unique, f"{tmp_path}/t", PATH, rows_per_shard=per_shard, keys_per_bucket=3)
    want = shards_by_hand([(r["doc_id"], r["text"]) for r in unique.collect()], library)
    again = token_files.open_files(spark, f"{tmp_path}/t", PATH)
    for opened in (written, again):
        got = token_files.read(opened, unique).withColumn("c", F.crc32("ids"))
        rows = [(r["doc_id"], r["start"], r["n_tokens"], r["c"]) for r in got.collect()]
        assert sorted(rows, key=str) == sorted(want, key=str)
    some = spark.createDataFrame([(3,), (77,), (-5,), (3,)], "doc_id long")
    assert [r["doc_id"] for r in token_files.read(written, some).collect()] == [3]


def test_repeated_keys_are_all_returned(spark, small, tmp_path):
    written = token_files.write(small, f"{tmp_path}/t", PATH)
    got = token_files.read(written, small).orderBy("start").collect()
    assert len(got) == 11 and sum(r["doc_id"] == 1 for r in got) == 2
    ends = [r["start"] + r["n_tokens"] for r in got]
    assert [r["start"] for r in got] == [0, *ends[:-1]]


def test_no_documents_no_files(spark, small, tmp_path):
    written = token_files.write(small.limit(0), f"{tmp_path}/t", PATH)
    assert token_files.read(written, small).count() == 0


def test_queries_equal_the_library(spark, sf, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {tuple(r) for r in op3_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    assert got == set(shards_by_hand(docs.items(), library))
    counts = {r["doc_id"]: r["n_tokens"] for r in op10_bpe(spark, sf).collect()}
    assert counts == {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t in docs.items()}


def test_files_of_another_kind_are_refused():
    for build in (bpe.HeapBpe, lambda path: token_files._library_encoder(path, 4)):
        with pytest.raises(ValueError, match="another kind"):
            build(public_tokenizers.path("byte_bpe_50k.json"))


def test_caches_are_bounded_and_change_nothing():
    calls = []
    cache = vocabulary.Cache(lambda key: calls.append(key) or key.encode(), 4_000)
    keys = [f"k{i % 50}" for i in range(500)] + ["x" * 1_000] * 3
    assert [cache[k] for k in keys] == [k.encode() for k in keys]
    assert len(cache) + len(cache.older) < 60 and calls.count("x" * 1_000) == 3
    assert all(len(k) <= vocabulary.CACHED_CHARS for k in [*cache, *cache.older])


def test_slices_of_texts_change_no_ids(library):
    texts = ["one two  three\n\nfour", None, "", " ", "long " * 400, "x" * 900, "Überall <|endoftext|>é ñ", "one two"] * 3
    expected = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = vocabulary.ChunkEncoder(PATH, bpe.HeapBpe(PATH).encode_piece)
    for size in (1, 7, 100, 1_000_000):
        assert list(encoder.encode_all(texts, size)) == expected
    assert list(encoder.encode_all([])) == [] and [encoder.encode(t) for t in texts] == expected
    assert list(vocabulary.texts_of(pa.array(texts), 5)) == texts


def test_latin_letters_need_no_call_of_the_library():
    path = vocabulary_path()
    library, encoder = Tokenizer.from_file(path), token_files._library_encoder.__wrapped__(path, 4)
    draw = random.Random(11)
    letters = [chr(x) for x in (*range(0x21, 0x7F), *range(0xC0, 0x100))] + ["'s", "'t", " ", " ", "\n", *"aeiouéüß"]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(3000)]
    # Other signs, parts of composed letters and letters with longer small forms stay with the library.
    rest = ["×÷ é", "é é", "İstanbul éa", "µm ªº é è", "œuvre Ÿ", "é­", "<|é|> É'S"]
    for text in texts + rest:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert not any(vocabulary.LATIN_TEXT.fullmatch(chunk) for chunk in ("×", "÷", "é", "İ", "µ", "œ", "é è"))
    encoder.split = encoder.normalize = None
    assert encoder.encode("Ça où, naïve Straße'S ÑANDÚ!") == b"".join(
        i.to_bytes(4, "little") for i in library.encode("Ça où, naïve Straße'S ÑANDÚ!", add_special_tokens=False).ids
    )
