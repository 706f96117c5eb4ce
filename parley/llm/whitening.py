"""Embedding whitening from the singular values of the centred rows, never from their products.

The fit list holds each distinct vector once. Every task reduces its centred
rows, block by block, to one triangular factor (QR); factors are stacked and
reduced sixteen at a time until one is left, whose Gram matrix is n times the
covariance. Its bidiagonal form gives the singular values by the qd transform and
the directions by twisted factorisations (`bidiagonal`). One more pass over
the fit list measures how far the covariance of the whitened rows is from the
identity. Sums are exact integers, so a row is centred without cancellation.

Only triangular factors and sums reach the driver: dimension squared numbers,
whatever the number of rows.

Defined cases: a vector that is null, empty, or holds a null or non-finite entry
takes no part, nor does one of another length than the commonest (ties: the
longest). Repeated rows and null ids are whitened like any other row.
A direction whose singular value is below 1e-10 of the largest has no spread to
scale and is left out; if all vectors are equal, or there are none, no rows come
back. `deviation` is null where it exceeds 64 bits. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.llm.bidiagonal import right_vectors
from parley.llm.shared import landed

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
# Triangular factors stacked at once, and the least part of the largest singular value that counts.
STACK, LEAST = 16, 1e-10
_LONG = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with their sums; eigenvalues of the covariance; directions over roots, as columns."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    directions: np.ndarray
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return (self.values[: self.directions.shape[1]] / self.values.sum()).tolist()


def whole_numbers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * entry) + offset of every entry; null for a vector that takes no part."""
    entry = F.transform(vector, lambda c: c.cast("double"))
    odd = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(entry, lambda c: F.floor(c * scale) + F.lit(offset).cast("long"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True)), whole)


def _block(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n times each row less the sums, exactly; Python numbers where 64 bits do not hold it."""
    if n * (int(np.abs(rows).max(initial=0)) + 1) >= _LONG:
        rows, sums = rows.astype(object), sums.astype(object)
    return rows * n - sums


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield _block(batch.column(0))


def _one_row(matrix: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if matrix is not None:
        yield pa.RecordBatch.from_pydict({"r": pa.array([matrix.ravel().tolist()], pa.list_(pa.float64()))})


def _triangle(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows of the fit list."""
    d = len(sums)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for rows in _columns(batches):
            rows = _centred(rows, n, sums).astype(float) / n
            found = np.linalg.qr(rows if found is None else np.vstack([found, rows]), mode="r")
        yield from _one_row(found if found is None else _padded(found, d))

    def reduce_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for factors in _columns(batches):
            for one in factors:
                one = one.reshape(d, d)
                found = one if found is None else _padded(np.linalg.qr(np.vstack([found, one]), mode="r"), d)
        yield from _one_row(found)

    factors = landed(fit.mapInArrow(reduce_rows, "r array<double>"), "whitening-factors")
    while (left := factors.count()) > 1:
        stacked = factors.repartition(-(-left // STACK))
        factors = landed(stacked.mapInArrow(reduce_factors, "r array<double>"), "whitening-factors")
    return np.array(factors.first()["r"]).reshape(d, d)


def _padded(triangle: np.ndarray, d: int) -> np.ndarray:
    return np.vstack([triangle, np.zeros((d - len(triangle), d))]) if len(triangle) < d else triangle


def _identity_error(fit: DataFrame, n: int, sums: np.ndarray, directions: np.ndarray) -> float:
    """The largest entry of the whitened rows' covariance less the identity."""
    k = directions.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for rows in _columns(batches):
            white = _centred(rows, n, sums).astype(float) / n @ directions
            sofar = np.vstack([white.T @ white, white.sum(axis=0)])
            found = sofar if found is None else found + sofar
        yield from _one_row(found)

    cells = fit.mapInArrow(products, "r array<double>").select(F.posexplode("r").alias("at", "x"))
    found = np.zeros((k + 1) * k)
    for row in cells.groupBy("at").agg(F.sum("x").alias("x")).collect():
        found[row["at"]] = row["x"]
    found = found.reshape(k + 1, k) / n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def fit(vectors: DataFrame, column: str = "x", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of a column of whole numbers; None if they have no spread."""
    usable = vectors.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    lengths = usable.groupBy(F.size("x").alias("d")).count()
    longest = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if longest is None:
        return None
    distinct = landed(usable.where(F.size("x") == longest["d"]).distinct(), "whitening-fit")
    n = distinct.count()
    sums = np.zeros(longest["d"], np.int64)
    for row in distinct.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        sums[row["at"]] = row["x"]
    triangle = _triangle(distinct, n, sums)
    squares = right_vectors(triangle, 0)[0]
    keep = int((squares > LEAST**2 * squares[0]).sum()) if squares[0] > 0 else 0
    if not keep:
        return None
    squares, right = right_vectors(triangle, min(keep, components))
    directions = right / np.sqrt(squares[: right.shape[1]] / n)
    return Whitening(n, sums, squares / n, directions, _identity_error(distinct, n, sums, directions))


def whitened(x: Column, model: Whitening) -> Column:
    """Struct of `deviation` and `whitened` (an entry per component) of vectors of whole numbers."""
    n, sums, directions = model.n, model.sums, model.directions

    @F.arrow_udf("deviation long, whitened array<double>")
    def whiten_rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch):
                yield pa.StructArray.from_arrays([pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64()))],
                                                 ["deviation", "whitened"])
                continue
            off = _centred(_block(batch), n, sums)
            if float(np.abs(off).max()) ** 2 * off.shape[1] >= _LONG:
                off = off.astype(object)
            deviation = [int(v) if v < 1 << 63 else None for v in (off * off).sum(axis=1)]
            white = off.astype(float) / n @ directions
            lists = pa.ListArray.from_arrays(
                np.arange(0, white.size + 1, white.shape[1], dtype=np.int32), pa.array(white.ravel())
            )
            yield pa.StructArray.from_arrays([pa.array(deviation, pa.int64()), lists], ["deviation", "whitened"])

    return whiten_rows(x)


def whiten(
    rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Per usable row and component: key, component, n, deviation, whitened, explained, identity_error."""
    numbers = rows.select(F.col(key).alias("id"), whole_numbers(F.col(vector)).alias("x"))
    model = fit(numbers, "x", components)
    if model is None:
        schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        empty = [F.lit(None).cast(c.dataType).alias(c.name) for c in StructType.fromDDL(schema)]
        return rows.select(F.col(key), *empty).limit(0)
    usable = numbers.where(F.col("x").isNotNull() & (F.size("x") == len(model.sums)))
    found = usable.select("id", whitened(F.col("x"), model).alias("w"))
    explained = F.array(*[F.lit(v) for v in model.explained])
    return found.select(
        "id", F.col("w.deviation").alias("deviation"), F.posexplode("w.whitened").alias("at", "whitened")
    ).select(
        F.col("id").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
