"""Every registered query against its SQL in DuckDB."""

import pytest
from oracle import compare, connect

from parley.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", ["weighted_head", "classifier_score"])
def test_scores_are_probabilities(spark, sf, name):
    rows = QUERIES[name](spark, sf)
    assert rows.count() > 0
    assert rows.where("score < 0 or score > 1 or decision <> cast(score >= 0.5 as int)").count() == 0
