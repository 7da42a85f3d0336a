import importlib

import pytest
from conftest import DATA
from oracle import check

from inkshred.plans import detail_queries, edit_queries, queries, style_queries


QUERIES, SQL = queries.QUERIES | edit_queries.QUERIES | style_queries.QUERIES | detail_queries.QUERIES, queries.SQL | edit_queries.SQL | style_queries.SQL | detail_queries.SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    check(spark, QUERIES[name], SQL[name], DATA)


def test_entry_imports_and_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 200
