"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from foldcast.plans.queries import ORACLES, QUERIES

from .conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 1000
    assert set(QUERIES) <= set(e.queries())
    assert set(ORACLES) <= set(e.oracle_sql())
