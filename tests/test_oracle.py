"""Every registered query against its SQL answer on the smallest tables."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
#: Full forests have no SQL answer to compare with; test_forest.py holds them against plain ones.
FULL_FORESTS = {"train_scores", "score_games", "holdout_metrics", "oob_metrics", "feature_importance", "permutation_importance"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in entry_points.queries() if n not in FULL_FORESTS])
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, SF, name)
    assert ok, note


def test_every_answer_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_flagship(spark):
    assert entry_points.entry(spark).count() > 0
