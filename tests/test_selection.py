"""Selection by digit counts against sorting, with hot groups, repeated rows and null groups."""

import pytest
from pyspark.sql import functions as F

from parley.operators import ordering, selection
from parley.operators.sampling import balanced_ids, cap_per_key


@pytest.fixture(scope="module")
def rows(spark):
    """A group with a third of all rows, small ones, a null one; some ids occur often."""
    group = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 17 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("g"), (F.col("id") % 23).cast("string"))
    )
    own = F.when(F.col("id") % 5 == 0, F.lit("often")).otherwise(F.col("id").cast("string"))
    return spark.range(0, 6000, 1, 7).select(group.alias("g"), own.alias("m"), F.lit(1).alias("_prefix"), F.lit(2).alias("_need_"))


def sorted_first(found, k):
    groups = {}
    for r in found:
        groups.setdefault(r["g"], []).append((r["d"], r["m"]))
    return {g: sorted(v)[:k] for g, v in groups.items()}


@pytest.mark.parametrize("bound", [1, 50, 4096])
@pytest.mark.parametrize("k", [1, 40, 900, 100_000])
def test_first_in_order_equals_sorting(spark, rows, monkeypatch, k, bound):
    monkeypatch.setattr(selection, "BOUND", bound)
    monkeypatch.setattr(selection, "DIGITS", 1 if bound == 1 else 3)
    df = rows.drop("_prefix").withColumn("d", F.md5("m"))
    got = selection.first_in_order(df, ["g"], F.col("d"), "m", k)
    assert got.columns == df.columns
    found = {}
    for r in got.collect():
        found.setdefault(r["g"], []).append((r["d"], r["m"]))
    assert {g: sorted(v) for g, v in found.items()} == sorted_first(df.collect(), k)


def test_without_groups_and_by_a_shuffle(spark, rows, monkeypatch):
    df = rows.drop("_prefix").withColumn("d", F.md5("m"))
    want = sorted((r["d"], r["m"]) for r in df.collect())[:77]
    got = sorted((r["d"], r["m"]) for r in selection.first_in_order(df, [], F.col("d"), "m", 77).collect())
    assert got == want
    monkeypatch.setattr(selection, "MANY_GROUPS", 0)
    joined = selection.first_in_order(df, ["g"], F.col("d"), "m", 9)
    assert joined.groupBy("g").count().where("count > 9").count() == 0
    assert selection.first_in_order(df.limit(0), ["g"], F.col("d"), "m", 9).count() == 0
    assert selection.first_in_order(df, ["g"], F.col("d"), "m", 0).count() == 0


def test_only_few_rows_are_put_in_order(spark, monkeypatch):
    seen = []

    def watched(df, order, out):
        seen.append(df.count())
        return ordering.sequence(df, order, out)

    monkeypatch.setattr(selection, "sequence", watched)
    df = spark.range(200_000).select(F.lit("one").alias("g"), F.col("id").cast("string").alias("m"))
    assert cap_per_key(df, "g", 50_000, id_col="m").count() == 50_000
    assert seen and max(seen) <= selection.BOUND


def test_cap_and_balance_on_a_hot_group(spark, rows):
    df = rows.drop("_prefix", "_need_").where("m <> 'often'")
    counts = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    got = {r["g"]: r["count"] for r in cap_per_key(df, "g", 60, id_col="m").groupBy("g").count().collect()}
    assert got == {g: min(60, n) for g, n in counts.items()}
    ids = balanced_ids(df, 500, "g", "m")
    assert ids.count() == 500 == ids.distinct().count()
    quota = 500 // len(counts)
    taken = ids.where("origin = 'quota'").join(df, "m").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in taken} == {g: min(quota, n) for g, n in counts.items()}
    assert balanced_ids(df, 3, "g", "m").count() == 3
    assert balanced_ids(df, 10**6, "g", "m").count() == df.count()


@pytest.mark.parametrize("bound", [1, 2, 100, 10_000])
@pytest.mark.parametrize("p", [0.0, 0.3334, 0.6, 0.999, 1.0])
def test_percentile_in_rounds(spark, p, bound):
    value = F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.hash("id"), F.lit(7919)) / 3.0 - 900)
    table = spark.range(9000).select(F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise(value).alias("x"))
    want = table.agg(F.percentile("x", F.lit(p))).first()[0]
    got = spark.range(1).select(selection.exact_percentile(table, "x", p, bound=bound)).first()[0]
    assert got == pytest.approx(want, abs=1e-9)


def test_percentile_of_nothing(spark):
    table = spark.range(3).select(F.lit(None).cast("double").alias("x"))
    assert spark.range(1).select(selection.exact_percentile(table, "x", 0.5)).first()[0] is None


def test_first_k_above_the_limit_with_null_keys(spark):
    table = spark.range(0, 4000, 1, 9).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("k"), "id")
    got = ordering.first_k(table, ["k"], [F.desc("id")], 1100, rank="r").groupBy("k").agg(F.count("*"), F.min("id"), F.max("r"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1100, 1800, 1100), (None, 1100, 1801, 1100)], key=str)
