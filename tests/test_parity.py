"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from colophon.plans import QUERIES, SQL
from parity import difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_beside_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert difference(df, SQL[name], FOLDER) == ""
    else:
        assert df.count() >= 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["dimension", "key", "cnt"]
