"""Every registered market query against its SQL twin in DuckDB, on the smallest given tables."""

import datetime
import math
import os
from pathlib import Path

import duckdb
import pytest

from marketspark.plans import queries as market

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(DIR).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.date() if v.time() == datetime.time() else v
    return v


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: (repr([v for v in r if not isinstance(v, float)]), repr(r)))


def same(a, b):
    """Equal; wealth beyond a double's 15 digits may differ in the last ones. Below a million this allows nothing."""
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12))


@pytest.mark.parametrize("name", sorted(market.oracle_sql()))
def test_query_has_its_twins_rows(spark, duck, name):
    got = market.queries()[name](spark, DIR)
    cursor = duck.execute(market.oracle_sql()[name])
    want_names, want = ordered([c[0] for c in cursor.description], cursor.fetchall())
    got_names, rows = ordered(got.columns, [tuple(r) for r in got.collect()])
    assert got_names == want_names and len(rows) == len(want) > 0
    assert [(g, w) for g, w in zip(rows, want, strict=True) if not all(map(same, g, w))] == []


@pytest.mark.parametrize("name", sorted(market.queries().keys() - market.oracle_sql().keys()))
def test_other_queries_give_rows(spark, name):
    assert market.queries()[name](spark, DIR).limit(1).count() == 1
