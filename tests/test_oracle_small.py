"""Every registered query against its DuckDB oracle on the smallest fixture."""

import pytest

from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

import __spark_entry__ as E
from parlance.plans.registry import ORACLE

NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    problems, n, _, _ = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert not problems, problems
