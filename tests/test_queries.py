"""All registered queries against their SQL on the small tables."""

import pytest
from oracle import compare

import __spark_entry__ as entry

SQL = entry.oracle_sql()


def test_entry_has_rows_and_every_sql_a_query(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    assert compare(entry.queries()[name](spark, sf), sf, SQL[name]) == ""
