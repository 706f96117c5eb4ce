"""Deterministic order and random numbers from hashes.

A hash of (seed, id) gives the same order on any engine, on any number of
partitions and after a lost executor; a random generator would not.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: number of values of an eight digit hexadecimal number.
HEX8 = 4294967296
# Means below this are drawn by inversion, larger ones by rejection.
SMALL_MEAN = 10
# Rejection accepts an attempt with a probability above 0.8; all fail with one below 1e-16.
ATTEMPTS = 24


def hash_order(seed: int, *ids: Column) -> Column:
    """Hexadecimal sort key of a row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def hash_word(digest: Column, word: int = 0) -> Column:
    """One of the four 32 bit words of a digest, as eight hexadecimal digits."""
    return F.substring(digest, 1 + 8 * word, 8)


def hash_uniform(digest: Column, word: int = 0) -> Column:
    """Number in [0, 1) from one word of a digest."""
    return F.conv(hash_word(digest, word), 16, 10).cast("long") / F.lit(float(HEX8))


def poisson_one_cdf(terms: int = 12) -> list[float]:
    """Cumulative Poisson(1) probabilities for 0 .. terms - 1."""
    out, total = [], 0.0
    for k in range(terms):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
    return out


def poisson_weight(word: Column) -> Column:
    """Poisson(1) draw for a word of a digest, by inversion.

    Words of equal length compare like the numbers they stand for, so no draw
    is ever converted, and most end after one or two comparisons.
    """
    limits = [math.ceil(p * HEX8) for p in poisson_one_cdf()]
    limits = [limit for limit in limits if limit < HEX8]
    draw = F.when(word < f"{limits[0]:08x}", 0)
    for k, limit in enumerate(limits[1:], start=1):
        draw = draw.when(word < f"{limit:08x}", k)
    return draw.otherwise(len(limits)).cast("long")


def poisson_limits(mean: int) -> list[int]:
    """Words from which a Poisson draw exceeds 0, 1, 2, ...: its distribution function in 32 bits."""
    out, term, total, k = [], math.exp(-mean), 0.0, 0
    while True:
        total += term
        limit = math.ceil(total * HEX8)
        if limit >= HEX8 or (k > mean and term < 1e-17):
            return out
        out.append(limit)
        k += 1
        term *= mean / k


def poisson_draw(mean: Column, word: Column, digest: Callable[[Column], Column]) -> Column:
    """Poisson draw for any whole mean, in constant work.

    A mean of 1 to 9 takes the inverse of the distribution function at
    ``word``; a larger one transformed rejection (Hoermann 1993), whose attempt
    number t reads two words of ``digest(t)``. A mean of 0 or missing gives 0.
    """
    tables = F.array(*[F.array(*map(F.lit, poisson_limits(m))) for m in range(1, SMALL_MEAN)])
    number = F.conv(word, 16, 10).cast("long")
    inverted = F.size(F.filter(F.get(tables, (mean - 1).cast("int")), lambda limit: limit <= number))
    tried = F.aggregate(
        F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)),
        F.lit(None).cast("long"),
        lambda drawn, t: F.coalesce(drawn, _attempt(mean.cast("double"), digest(t))),
    )
    return (
        F.when(F.coalesce(mean, F.lit(0)) <= 0, F.lit(0))
        .when(mean == 1, poisson_weight(word))
        .when(mean < SMALL_MEAN, inverted)
        .otherwise(F.coalesce(tried, mean))
        .cast("long")
    )


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _attempt(mean: Column, digest: Column) -> Column:
    """One attempt of transformed rejection: the draw, or null. The numbers are the paper's."""
    b = 0.931 + 2.53 * F.sqrt(mean)
    a = -0.059 + 0.02483 * b
    scale = 1.1239 + 1.1328 / (b - 3.4)
    at_once = 0.9277 - 3.6224 / (b - 2)

    def place(d: Column) -> Column:
        u = (F.conv(hash_word(d), 16, 10).cast("double") + 0.5) / HEX8 - 0.5
        v = (F.conv(hash_word(d, 1), 16, 10).cast("double") + 0.5) / HEX8
        return F.struct(u.alias("u"), v.alias("v"), (0.5 - F.abs(u)).alias("edge"))

    def draw(p: Column) -> Column:
        k = F.floor((2 * a / p["edge"] + b) * p["u"] + mean + 0.43)
        return F.struct(k.alias("k"), p["v"].alias("v"), p["edge"].alias("edge"))

    def judge(p: Column) -> Column:
        v, edge, k = p["v"], p["edge"], p["k"]
        hat = F.log(v * scale / (a / (edge * edge) + b))
        never = (k < 0) | ((edge < 0.013) & (v > edge))
        return F.when((edge >= 0.07) & (v <= at_once), k).when(~never & (hat <= _poisson_log(k, mean)), k)

    return _bind(_bind(_bind(digest, place), draw), judge)


def _poisson_log(k: Column, mean: Column) -> Column:
    """Logarithm of the Poisson probability of k; no large terms cancel, so it holds for large means."""
    # Stirling's series with four terms is exact to 1e-10 from 10 on.
    rest = 1 / (12 * k) - 1 / (360 * k**3) + 1 / (1260 * k**5) - 1 / (1680 * k**7)
    large = k * F.log(mean / k) + (k - mean) - 0.5 * F.log(2 * math.pi * k) - rest
    small = k * F.log(mean) - mean - F.get(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)]), k.cast("int"))
    return F.when(k < 10, small).otherwise(large)
