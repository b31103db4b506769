"""Every registered query runs on the smallest tables and matches its SQL where it has one."""

import sys

import pytest

sys.path.insert(0, "tools")
import __spark_entry__ as E  # noqa: E402
from tools.check import connect, rows  # noqa: E402

PATH = "/root/testdata/sf0.001"
QUERIES, SQL = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, PATH)
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        rel = duck.execute(SQL[name])
        cols, want = [d[0] for d in rel.description], rel.fetchall()
        assert sorted(cols) == sorted(df.columns)
        assert rows(df.columns, got) == rows(cols, want)
    else:
        assert got or name in ("second_line_features",)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_a_stable_schema(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[0] == "star_name"
