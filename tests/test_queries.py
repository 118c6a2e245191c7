"""Each registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime as dt
import decimal
import os

import duckdb
import pytest

from memloom.plans import registry
from memloom.plans.fixtures import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_matches_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    have = sorted(([plain(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=repr)
    found = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(df.columns)
    place = {c: i for i, c in enumerate(found.columns)}
    want = sorted(([plain(r[place[c]]) for c in sorted(found.columns)] for r in found.fetchall()), key=repr)
    assert have == want


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
