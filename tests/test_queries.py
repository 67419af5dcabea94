"""Every registered query against its DuckDB text, and against plans that do not scale."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from caseload.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
catalog.load()
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
             "FlatMapGroupsInPandas")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_duckdb(spark, con, name):
    assert name in ORACLES
    error, _, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert error is None, error


SIDE_EFFECTS = ("m7_", "s1_", "s2_", "s4_", "s7_stored", "s12_", "u1_merge", "u6_", "st1_", "st3_", "st4_")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(SIDE_EFFECTS)))
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["period", "response_hours", "label", "trend"]
    assert df.count() > 0
