"""Every registered query against its SQL twin; those without one must return rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare_frame, duck

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_twins_belong_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == [
        "seed", "event_weighted_auc", "scenario_balanced_auc", "manipulation_vs_normal_auc", "recon_vs_normal_auc",
    ]
    assert df.count() == 20


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare_frame(df, con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_returns_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
