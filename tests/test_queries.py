"""Every registered query against its SQL, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from stackweave import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(row):
    return tuple(round(x, 9) if isinstance(x, float) and math.isfinite(x) else x for x in row)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    if name not in queries.ORACLES:
        assert got.count() >= 1
        return
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = Counter(map(plain, got.select(*want.columns).collect()))
    assert rows == Counter(map(plain, want.fetchall()))


def test_queries_have_rows(spark):
    empty = [n for n, q in queries.QUERIES.items() if q(spark, "/root/testdata/sf0.01").limit(1).count() == 0]
    assert empty == []
