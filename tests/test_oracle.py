"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sitescope.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    con.sql("set TimeZone = 'UTC'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(frame):
    return sorted(tuple(cell(v) for v in r) for r in frame)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    mine = rows([r[c] for c in columns] for r in got.collect())
    theirs = rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert mine == theirs


def test_every_query_without_sql_runs(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)):
        assert registry.QUERIES[name](spark, str(DATA)).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
