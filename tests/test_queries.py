"""Every registered query of the core against its SQL twin, and that all of them run."""

import pytest
from oracle import DATA, compare

from slicewright import plans

QUERIES, SQL = plans.queries(), plans.oracles()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    compare(spark, QUERIES[name], SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "hard_case_ranking" in e.queries()
