"""Every registered query with SQL gives DuckDB's rows."""

import __spark_entry__
import pytest

SQL = __spark_entry__.oracle_sql()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, small, name):
    df = __spark_entry__.queries()[name](spark, small)
    columns = sorted(df.columns)
    found = tables.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    wanted = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert ordered(map(tuple, df.select(columns).collect())) == ordered(wanted)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(__spark_entry__.queries())
