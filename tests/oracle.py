"""Compare a registered query with its oracle SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return value


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences in columns, types and rows; empty when equal."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    types = {d[0]: str(d[1]) for d in expected.description}
    rows = expected.fetchall()
    got_names = spark_df.columns
    if sorted(names) != sorted(got_names):
        return [f"columns {sorted(got_names)} != {sorted(names)}"]
    order = sorted(names)
    kinds = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN",
    }
    problems = [
        f"type of {n}: {t} != {types[n]}"
        for n, t in spark_df.dtypes
        if kinds.get(t, t) != types[n]
    ]
    got = Counter(tuple(_cell(r[n]) for n in order) for r in spark_df.collect())
    at = {n: i for i, n in enumerate(names)}
    want = Counter(tuple(_cell(r[at[n]]) for n in order) for r in rows)
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        problems.append(
            f"rows {sum(got.values())} != {sum(want.values())}\n  only spark {extra}\n  only sql {missing}"
        )
    return problems
