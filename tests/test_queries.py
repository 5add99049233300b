"""Every query of the library against its SQL."""

import pytest
from compare import duck_rows, spark_rows

from lanewise.plans.registry import QUERIES, SQL


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(SQL[name], sf_dir)


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect()) == 4
    assert set(e.oracle_sql()) <= set(e.queries())
