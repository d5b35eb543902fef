"""Plan rules as tests: no cartesian / nested-loop joins, no row-at-a-time Python,
and Python (Arrow) evaluation only in the p-value queries."""
import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

ORACLE = sorted(E.oracle_sql())
PVALUE = {"m1_welch_pvalues", "m2_feature_screen_pvalues", "m3_anova_pvalues", "m4_dimension_power"}


def _plan(spark, name):
    return E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ORACLE)
def test_no_pairing_joins_and_no_python(spark, name):
    plan = _plan(spark, name)
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", plan), name
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", plan), name


@pytest.mark.parametrize("name", sorted(PVALUE))
def test_python_only_on_result_rows(spark, name):
    plan = _plan(spark, name)
    assert "BatchEvalPython" not in plan          # never row-at-a-time
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", plan)
