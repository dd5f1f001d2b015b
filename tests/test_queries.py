"""Every registered query with SQL gives the SQL's rows on the smallest tables; the others give rows."""

import math
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
NAMES = [n for n in entry.registry.queries()]
EMPTY = {"u04_difference", "c19_hyphen_audit"}  # no such rows in the smallest tables


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry.registry.queries()[name](spark, DATA)
    got = df.collect()
    sql = entry.registry.oracle_sql().get(name)
    if sql is None:
        assert got or name in EMPTY
        return
    want = db.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
