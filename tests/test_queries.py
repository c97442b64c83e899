"""Every library query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from darkroom.plans import queries as plans

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    base = duckdb.connect()
    base.execute("SET TimeZone = 'UTC'")
    for file in SF.glob("*.parquet"):
        base.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return base


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, int):
        return value
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, oracle, name):
    out = plans.queries()[name](spark, str(SF))
    got = table(out.columns, [tuple(r) for r in out.collect()])
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got[0]
        return
    found = oracle.sql(sql)
    want = table(found.columns, found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in got[1]] == [
        tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in want[1]
    ]
