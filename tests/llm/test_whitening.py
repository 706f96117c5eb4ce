"""Whitening against a dense eigensolver, the qd solver on awkward matrices, and odd rows."""

import numpy as np
import pytest

from parley.llm import bidiagonal, whitening

SCHEMA = "vec_id long, embedding array<float>, x int, w string"


def brute(rows, components=16):
    kept = [(i, v) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all()]
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000 for i, v in kept}
    distinct = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    off = (distinct * n - sums) / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in x.items():
        white = (v * n - sums) / n @ vectors[:, :components] / np.sqrt(values[:components])
        out[i] = (n, int(((n * v - sums) ** 2).sum()), white)
    return out, values / values.sum()


def test_equals_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, 2, 20) * np.linspace(3, 0.5, 20)]) for i in range(300)]
    rows += [(1000, rows[0][1]), (1001, None), (1002, [None] + rows[1][1][1:]), (1003, [float("nan")] + rows[1][1][1:]),
             (1004, [float("inf")] + rows[1][1][1:]), (1005, [])]
    df = spark.createDataFrame([(i, v, 0, "w") for i, v in [*rows, (1006, [1.0, 2.0])]], SCHEMA)
    got = whitening.whiten(df.repartition(5)).collect()
    want, explained = brute(rows)
    assert {r["vec_id"] for r in got} == set(want)
    assert len(got) == 16 * len(want)
    found = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(1, 17):
        sign = np.sign(found[0, k]["whitened"] * want[0][2][k - 1])
        for i, (n, deviation, white) in want.items():
            r = found[i, k]
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["whitened"] == pytest.approx(sign * white[k - 1], abs=1e-9)
            assert r["explained"] == pytest.approx(explained[k - 1], rel=1e-9)
            assert r["identity_error"] < 1e-10


def test_repeated_rows_and_null_ids_are_whitened(spark):
    rows = [(1, [1.0, 0.0], 0, ""), (1, [1.0, 0.0], 0, ""), (None, [0.0, 3.0], 0, ""), (2, [5.0, 1.0], 0, "")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 8 and {r["n"] for r in got} == {3}
    assert len({(r["component"], r["whitened"]) for r in got if r["vec_id"] == 1}) == 2


def test_no_spread_gives_no_rows(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")], SCHEMA)
    assert whitening.whiten(same).collect() == []
    assert whitening.whiten(same.limit(0)).collect() == []
    assert whitening.whiten(same.limit(0)).columns == whitening.whiten(same).columns
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 0, "") for i in range(5)], SCHEMA)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}


def _matrices():
    rng = np.random.default_rng(5)
    turned, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    yield rng.standard_normal((200, 40))
    yield rng.standard_normal((200, 40)) * np.logspace(0, -6, 40)
    yield np.eye(12)
    yield np.vstack([np.eye(6)] * 2) * np.array([3, 3, 2, 2, 2, 1.0])
    yield rng.standard_normal((50, 4)) @ rng.standard_normal((4, 20))
    yield np.linalg.qr(rng.standard_normal((90, 30)))[0] * np.array([5.0] * 15 + [1 + 1e-9 * i for i in range(15)]) @ turned
    yield rng.standard_normal((9, 1))


@pytest.mark.parametrize("matrix", list(_matrices()), ids=lambda m: str(m.shape))
def test_values_and_vectors_of_the_qd_solver(matrix):
    d = matrix.shape[1]
    r = np.linalg.qr(matrix, mode="r")
    r = np.vstack([r, np.zeros((d - len(r), d))])
    want = np.zeros(d)
    found = np.linalg.svd(matrix, compute_uv=False) ** 2
    want[: len(found)] = found
    rank = int((want > 1e-20 * want[0]).sum())
    values, vectors = bidiagonal.right_vectors(r, rank)
    assert np.abs(values - want).max() <= 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(rank)).max() < 1e-12
    assert np.abs(matrix.T @ (matrix @ vectors) - vectors * values[:rank]).max() < 1e-12 * want[0]


def test_graded_values_are_accurate_one_by_one():
    a, b = np.logspace(0, -12, 25), np.full(24, 1e-14)
    dense = np.diag(a) + np.diag(b, 1)
    values = bidiagonal.squared_values(a, b)
    assert np.allclose(np.sqrt(values), np.linalg.svd(dense, compute_uv=False), rtol=1e-3, atol=0)
    assert np.sqrt(values[-1]) == pytest.approx(1e-12, rel=1e-3)


def test_a_deviation_beyond_64_bits_is_null():
    model = whitening.Whitening(1 << 40, np.array([0]), np.array([1.0]), np.array([[1.0]]), 0.0)
    off = whitening._centred(np.array([[1 << 30]]), model.n, model.sums)
    assert off[0, 0] == 1 << 70
