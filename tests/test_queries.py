"""Every query against its SQL on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from pelagos.plans import catalog

SF = "/root/testdata/sf0.001"
RUNS, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 7) + 0.0)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, duck, name):
    df = RUNS[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == want
