"""The search index against a scan, what a search reads, and sitemap files from disk to entries."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from sitescope.operators import search as I
from sitescope.sources import io as S

LIMITS = {"b": (4, True), "a": (7, False), "none": (3, False)}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rnd = random.Random(1)
    rows = [(kind, k, f"T{k}", rnd.choice([None, "", "Red шапка", "red", "a%b_c\\", "x" * 40]) if k % 7 == 0 else " ".join(rnd.choice(["Red", "reds", "Шапка", "list1", "1", "deer", "%", "É"]) for _ in range(6))) for kind in "ab" for k in range(300)]
    folder = f"{tmp_path_factory.mktemp('search')}/index"
    I.write_index(spark.createDataFrame(rows + [("a", None, "t", "red")], "kind string, id long, title string, text string"), folder)
    return rows, folder


@pytest.mark.parametrize("verified", [1000, 3])
@pytest.mark.parametrize("q", ["red", "r", "ds", "шапка", "ПКА РЕД", " list1 1 ", "%", "a%b_c\\", "s s", "d red", "zzz", "", "é", "x" * 30])
def test_search_against_a_scan(spark, index, q, verified, monkeypatch):
    rows, folder = index
    monkeypatch.setattr(I, "VERIFIED", verified)
    said, want = q.strip().lower(), []
    for kind, (limit, last) in LIMITS.items():
        hits = sorted((r for r in rows if r[0] == kind and said and said in (r[3] or "").lower()), key=lambda r: -r[1] if last else r[1])
        want += [r[:3] for r in hits[:limit]]
    assert [tuple(r) for r in I.search(spark, folder, q, LIMITS, 9).collect()] == want[:9]


def test_search_reads_only_its_own_lists(spark, index):
    _, folder = index
    for q, pushed in (("red шапка", "In(run"), ("red", "EqualTo(run"), ("re", "StringStartsWith(run")):
        plan = I.candidates(spark, folder, q)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: [^\n]*part#\d+ (IN|=)", plan) and pushed in plan, plan
    nothing = I.candidates(spark, folder, "zzzz")._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in nothing


def test_sitemap_tree_from_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).mkdir()
        if int(name[-1]) % 2:
            (tmp_path / name / "f.xml").write_text(text, encoding="utf-8")
        else:
            (tmp_path / name / "f.xml.gz").write_bytes(gzip.compress(text.encode()))

    leaf = lambda *urls: '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<url><loc> {u} </loc><priority>{p}</priority></url>" for u, p in urls) + "</urlset>"
    index = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in names) + "</sitemapindex>"
    put("i0", index("i1", "l3", "i0", "l9"))
    put("i1", index("l2", "l3", "i0", "i5"))
    put("i5", index("l6"))
    put("l2", leaf(("https://e/a", "0.2"), ("https://e/pic.jpg", "1")))
    put("l3", leaf(("https://e/a", "0.3"), ("https://e/b", "0.3"), ("https://e/b", "0.4")))
    put("l6", leaf(("https://e/c", "0.6"), ("https://e/b", "0.6")))
    put("l8", leaf(("https://e/never", "0.8"),))
    got = S.read_sitemap_tree(spark, f"{tmp_path}/*", ["i0"], lambda file: F.regexp_extract(file, "/([il][0-9])/", 1))
    assert {r["url"]: (r["sitemap_url"], r["priority"], r["lastmod"]) for r in got.collect()} == {"https://e/a": ("l3", "0.3", ""), "https://e/b": ("l3", "0.3", ""), "https://e/c": ("l6", "0.6", "")}
    assert S.read_sitemap_tree(spark, f"{tmp_path}/*", ["unknown"], lambda file: F.lit("i0")).count() == 0
