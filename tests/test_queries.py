"""Every registered procurement query against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pytest

from tenderloom.plans.catalog import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        out.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return out


#: Tested against a library: SQL has no keyed digests.
WITHOUT_SQL = {"signed_neighbours"}


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLE_SQL)


def told(x):
    return f"{x:.9g}" if isinstance(x, float) else "null" if x is None else str(x)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, D), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = [Counter(tuple(map(told, r)) for r in side) for side in (got.select(columns).collect(), want.select(", ".join(columns)).fetchall())]
    assert rows[0] == rows[1], [list((rows[0] - rows[1]).items())[:3], list((rows[1] - rows[0]).items())[:3]]
