"""Every registered query with SQL gives the same rows as that SQL, on the smallest tables."""

import math

import pytest

from folioframe.plans import catalog
from tests.conftest import ROOT

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool) or isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if hasattr(value, "as_integer_ratio"):
        return repr(float(value))
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, duck):
    df = QUERIES[name](spark, ROOT)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in cur.fetchall())
    assert got == want


def test_each_query_without_sql_runs(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, ROOT).count() > 0, name
