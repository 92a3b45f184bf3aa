"""Every registered query against its DuckDB oracle on the smallest driver tables
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from quire.plans import registry
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_oracle_or_is_listed():
    no_sql = set(registry.queries()) - set(registry.oracle_sql())
    assert no_sql == set(), f"queries without oracle SQL: {sorted(no_sql)}"


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    built = {}

    def fn(s, sf):
        built["df"] = E.queries()[name](s, sf)
        return built["df"]

    line = compare(spark, con, name, fn, E.oracle_sql().get(name), SF)
    assert line.startswith("OK"), line
    # plan shape: no Cartesian product and no nested-loop join
    plan = built["df"]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, plan


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["strategy", "n_success", "n_rows", "pct_success"]
