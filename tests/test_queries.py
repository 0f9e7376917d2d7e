"""Every registered query runs; where it has SQL, DuckDB gives the same rows."""

import math
from pathlib import Path

import duckdb
import pytest

from stintforge.plans import registry

ROOT = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(ROOT).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else ("f", round(value, 6) + 0.0)
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    return value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, ROOT)
    names = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
