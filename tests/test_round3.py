"""Queries whose inputs grow with the tables, on pages enough to tell."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sitescope.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Three times the smallest table's pages, and the tables beside them."""
    folder = tmp_path_factory.mktemp("many")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    copies = pages.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).withColumn("page_id", F.col("page_id") + F.col("k") * 1000)
    copies.withColumn("url", F.concat("url", F.lit("-"), "k")).drop("k").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    spark.read.parquet(f"{DATA}/nation.parquet").coalesce(1).write.parquet(f"{folder}/nation.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["l06_flags", "l11_donor_suggestions", "x07_recommendations"])
def test_sites_grow_with_the_pages(spark, many, name):
    """Seven sites however many pages, in the query and in its SQL."""
    got = registry.QUERIES[name](spark, many)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for table in ("pages", "nation"):
        con.sql(f"create view {table} as select * from '{many}/{table}.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall()
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want)) and "count(*) / 250" not in registry.ORACLE_SQL[name]
    if "site" in columns:
        assert {r[columns.index("site")] for r in rows} == {f"s{k}" for k in range(7)}


def test_activity_reads_tasks_and_audits(spark):
    """The newest of both kinds; the log has a query of its own."""
    n = 2 * spark.read.parquet(f"{DATA}/orders.parquet").count()
    con = duckdb.connect()
    for table in ("orders", "events"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    whole = registry.ORACLE_SQL["w16_activity"].rsplit("LIMIT", 1)[0]
    assert len(con.sql(whole).fetchall()) == n
    for name in ("w16_activity", "w16_activity_from_log"):
        assert [tuple(r) for r in registry.QUERIES[name](spark, DATA).collect()] == con.sql(registry.ORACLE_SQL[name]).fetchall()
