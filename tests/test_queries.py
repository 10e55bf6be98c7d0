"""Every registered query of the library that SQL can express, against DuckDB."""

import pytest

from cairnmap.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, data, duck, same, name):
    same(catalog.QUERIES[name](spark, data), duck.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["A23_drop_redundant", "L17_A26_cluster_sizes", "J7_hierarchical", "M4_U4_U5_smote"])
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
