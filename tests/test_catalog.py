"""Every query against its SQL on the smallest tables, where they are at hand."""

import datetime as dt
import glob
import os

import pytest

import __spark_entry__ as entry

DIR = os.environ.get("NEUROLITH_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return repr(0.0 if x == 0 else x) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert sorted(tuple(plain(r[k]) for k in order) for r in df.collect()) == sorted(tuple(plain(r[names.index(k)]) for k in order) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    df = entry.queries()[name](spark, DIR)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_no_oracle_without_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
