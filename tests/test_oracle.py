"""Every query with oracle SQL gives the same names, types and rows as DuckDB."""

from __future__ import annotations

import pytest
from check_oracle import compare, duck_tables

from sievework import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    return duck_tables(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, db, name):
    problem = compare(catalog.QUERIES[name](spark, SF), db, catalog.ORACLE[name])
    assert problem is None, problem


def test_entry_points(spark):
    import __spark_entry__ as entry_points

    assert entry_points.entry(spark).count() == 3
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
