"""The training-data queries against their SQL twins, and that all of them run."""

import pytest
from oracle import DATA, compare

from slicewright.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    compare(spark, QUERIES[name], ORACLES[name], duck)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
