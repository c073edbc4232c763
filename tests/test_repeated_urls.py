"""Queries over pages of which some share an address, against their SQL."""

from pathlib import Path

import duckdb
import pytest

from sitescope.plans import registry
from sitescope.sources import io as S
from tests.test_oracle import rows

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables, with every fifth page at the address of the page before it."""
    out = tmp_path_factory.mktemp("repeated")
    pages = f"(SELECT * REPLACE (CASE WHEN page_id % 5 = 4 THEN lag(url) OVER (ORDER BY page_id) ELSE url END AS url) FROM '{DATA}/pages.parquet')"
    duckdb.sql(f"COPY {pages} TO '{out}/pages.parquet'")
    duckdb.sql(f"COPY (FROM '{DATA}/nation.parquet') TO '{out}/nation.parquet'")
    return out


@pytest.mark.parametrize("name", ["s10_flat_report", "x04_hub_candidates", "x06_classified", "i05_page_images", "s02_sitemap"])
def test_query(spark, folder, name):
    got = registry.QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    with duckdb.connect() as con:
        for table in ("pages", "nation"):
            con.sql(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
        want = con.sql(registry.ORACLE_SQL[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert rows([r[c] for c in columns] for r in got.collect()) == rows(want)


def test_a_sitemap_s_addresses_stand_once_their_entries_as_often_as_written(spark, tmp_path):
    entry = "<url><loc>https://e.example/{}</loc><priority>{}</priority></url>"
    for k, body in enumerate((entry.format("a", 1) + entry.format("b", 2) + entry.format("a", 3), entry.format("a", 4))):
        (tmp_path / f"{k}.xml").write_text(f"<urlset>{body}</urlset>")
    found = lambda df: sorted((r["url"][-1], r["priority"]) for r in df.collect())
    assert found(S.read_entries(spark, str(tmp_path))) == [("a", "1"), ("a", "3"), ("a", "4"), ("b", "2")]
    assert found(S.read_sitemap(spark, str(tmp_path))) == [("a", "1"), ("b", "2")]
