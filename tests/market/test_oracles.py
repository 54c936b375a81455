"""Every registered market query against its SQL on the small tables, and a row check for the others."""

import math

import duckdb
import pytest

from barloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    import os

    db = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return db


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return repr(round(float(x), 6) + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    if name in SQL:
        cur = con.execute(SQL[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == names
        want = sorted((tuple(plain(dict(zip(cols, r, strict=True))[c]) for c in names) for r in cur.fetchall()), key=str)
        as_float = lambda t: tuple(plain(float(x)) if x and x.replace(".", "", 1).replace("-", "", 1).isdigit() else x for x in t)
        assert sorted(map(as_float, got), key=str) == sorted(map(as_float, want), key=str)
    else:
        assert got or name == "c19_adx_trend"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
