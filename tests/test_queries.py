"""The registered queries against their SQL, and promises about their plans."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck
from tablelore.workload import inputs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("test tables are not here")
    rows = entry.entry(spark).collect()
    assert len(rows) == len(inputs.TABLES)


def test_no_cross_join_and_no_python_in_hot_plans(spark):
    for name in ("column_nulls", "column_uniqueness", "duplicate_rows", "pii_values", "pii_documents", "drift", "relationship_map"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
            assert word not in plan, (name, word)
