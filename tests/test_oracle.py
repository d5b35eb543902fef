"""Every registered query with an oracle equals its DuckDB SQL (sf0.001, all rows)."""
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_compare import compare, duck_connect

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert res["status"] == "ok", res
