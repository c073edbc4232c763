"""Rules with texts and pages written by hand."""

import pytest
from pyspark.sql import functions as F

from sitescope.functions import html as H
from sitescope.functions import urls as U
from sitescope.functions import words as W
from sitescope.operators import links as L
from sitescope.operators import metadesc as M
from sitescope.operators import siteaudit as A
from sitescope.operators import texts as T
from sitescope.operators import workspace as WS
from sitescope.sources import io as S


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("url", "key"), [
    ("HTTP://WWW.Example.com//a//b/?utm_source=x&page=2#z", "http://example.com/a/b?page=2"), ("https://example.com", "https://example.com/"),
    ("https://example.com/?PAGED=3&gclid=1", "https://example.com/?PAGED=3"), ("//example.com/a/", "https://example.com/a"),
])
def test_page_key(spark, url, key):
    assert one(spark, U.page_key("u"), u=url) == key


@pytest.mark.parametrize(("pattern", "hit"), [("*/news/*", True), ("?utm_", True), ("?page", False), ("/news/", True), ("/news/?.html", False), ("*a?.html*", True), ("", False)])
def test_exclusions(spark, pattern, hit):
    assert one(spark, U.excludes("u", "p"), u="https://e.com/news/ab.html?utm_source=1", p=pattern) is hit


@pytest.mark.parametrize(("length", "codes"), [(0, {"missing_title"}), (29, {"title_length"}), (30, set()), (65, set()), (66, {"title_length"})])
def test_title_thresholds(spark, length, codes):
    page = dict(status_code=200, title="t" * length, description="d" * 100, h1_count=1, canonical="x", robots="", word_count=200, internal_links=3, missing_alt=0)
    assert {i["code"] for i in one(spark, A.core_issues(), **page)} == codes


@pytest.mark.parametrize(("length", "codes"), [(69, {"description_length"}), (70, set()), (170, set()), (171, {"description_length"})])
def test_description_thresholds(spark, length, codes):
    page = dict(status_code=200, title="t" * 40, description="d" * length, h1_count=1, canonical="x", robots="", word_count=200, internal_links=3, missing_alt=0)
    assert {i["code"] for i in one(spark, A.core_issues(), **page)} == codes


PAGE = """<html><head><title>A &amp; B</title><meta name="robots" content="noindex"><link rel="canonical" href="/c">
<script type="application/ld+json">{"@type":"Product","name":"Pump","model":"M1"}</script></head>
<body><nav><a href="/menu">Menu</a></nav><ol class="breadcrumbs"><a href="/cat/">Pumps</a></ol><main><h1>Pump</h1><p>Насос предназначен для подачи чистой воды в дом.
<p>second</p></main><h2>Похожие услуги</h2><div><a href="/r">R</a></div><footer><a href="#">x</a><a href="/f">F</a></footer>
<img src="i.png"><form></form></body></html>"""


def test_html_features():
    f = H.features(PAGE, "https://e.com/d/p")
    assert f["title"] == "A & B" and f["robots"] == "noindex" and f["canonical"] == "https://e.com/c"
    assert [(x["target"], x["type"]) for x in f["links"]] == [("https://e.com/menu", "menu"), ("https://e.com/cat/", "breadcrumbs"), ("https://e.com/r", "related"), ("https://e.com/f", "footer")]
    assert f["has_cta"] and not f["has_faq"] and f["jsonld"] == ["product"]
    assert [x["label"] for x in f["product"]["facts"]] == ["Модель", "Категория", "Назначение"]
    assert f["images"][0]["src"] == "https://e.com/d/i.png" and not f["images"][0]["has_alt"]


def test_empty_html():
    f = H.features(None, None)
    assert f["title"] == "" and f["links"] == [] and f["word_count"] == 0


def test_stems():
    assert W.stem("насосы") == W.stem("насосов") == "насос"
    assert W.stem("the") == "the"


def test_depth_and_flags(spark):
    pages = spark.createDataFrame([("s", k) for k in "habcd"], "site string, key string")
    links = spark.createDataFrame([("s", a, b, "x", "content", 1) for a, b in ("ha", "ab", "bc", "ca", "aa")], "site string, src_key string, dst_key string, anchor string, link_type string, pos int")
    homes = spark.createDataFrame([("s", "h")], "site string, key string")
    m = {r["key"]: r for r in L.page_metrics(pages, links, homes).collect()}
    assert {k: m[k]["depth"] for k in m} == {"h": 0, "a": 1, "b": 2, "c": 3, "d": None}
    assert m["d"]["orphan"] and m["d"]["unreachable"] and not m["h"]["orphan"] and m["a"]["incoming"] == 2 and m["b"]["weak"]


def test_suggested_description():
    text, used, notes = M.propose("Насос", "product", [{"label": "Масса", "value": "5 кг", "source": ""}, {"label": "Производитель", "value": "ООО Завод, тел. 8 (912) 345-67-89", "source": ""}], "")
    assert text.startswith("Насос массой 5 кг") and "Масса" in used and "345" not in text and len(text) <= 160
    assert M.propose("", "product", [], "")[2] == ["no_subject"]


@pytest.mark.parametrize(("text", "day"), [("05.03.2024", "2024-03-05"), ("2024-03-05", "2024-03-05"), ("5/3/2024", "2024-03-05"), ("до 5-3-2024!", "2024-03-05"), ("31.02.2024", None), (None, None)])
def test_deadlines(spark, text, day):
    row = spark.createDataFrame([(text,)], "t string").select(F.date_format(WS.deadline(F.col("t")), "yyyy-MM-dd").alias("d")).first()
    assert row["d"] == day


def test_brief(spark):
    text = "**URL:** https://e.com/x\nДобавьте в текст ключевые слова\n- насос: 1-2 (найдено: 3)\nДобавьте в текст LSI\nвода\nГлавное ключевое слово:** насос\n"
    b = T.parse_briefs(spark.createDataFrame([(1, text)], "brief_id int, text string")).first()
    assert b["url"] == "https://e.com/x" and b["lsi"] == ["вода"] and b["main_keyword"] == "насос"
    assert [tuple(k) for k in b["keywords"]] == [("насос", 1, 2, 3)]


def test_routing_is_deterministic(spark):
    role, intent = WS.route("t")
    rows = spark.createDataFrame([("check the sitemap index",), ("hello",), (None,)], "t string").select(role.alias("r"), intent.alias("i")).collect()
    assert [tuple(r) for r in rows] == [("seo", "audit"), ("coordinator", "chat"), ("coordinator", "chat")]


def test_depth_of_a_long_chain(spark):
    n = 70
    pages = spark.createDataFrame([("s", str(k)) for k in range(n)], "site string, key string").coalesce(1)
    links = spark.createDataFrame([("s", str(k), str(k + 1), "x", "content", 1) for k in range(n - 1)], "site string, src_key string, dst_key string, anchor string, link_type string, pos int").coalesce(1)
    homes = spark.createDataFrame([("s", "0")], "site string, key string").coalesce(1)
    found = {r["key"]: r["depth"] for r in L.depths(L.edges(links), pages, homes).collect()}
    assert found == {str(k): k for k in range(n)}


def test_topics_of_long_titles_and_keywords(spark):
    title = " ".join(f"word{k}x" for k in range(80))
    pages = spark.createDataFrame([("https://e.com/a/red-shoes", title, "", ["насос", "вода"])], "url string, title string, h1 string, keywords array<string>")
    assert set(L.page_topics(pages).first()["tokens"]) == {*title.split(), "red", "shoes", "насос", "вода"}
    assert len(L.page_topics(pages.drop("keywords")).first()["tokens"]) == 82


def test_sitemap_index_of_many_levels(spark):
    n = 700
    files = spark.createDataFrame([(f"s{k // 8}", f"s{k}") for k in range(1, n)] + [("s699", "s0x"), ("s0x", "s0")], "sitemap_url string, child string")
    roots = spark.createDataFrame([("s0",)], "sitemap_url string")
    inner = {f"s{k // 8}" for k in range(1, n)} | {"s699", "s0x"}
    found = [r["sitemap_url"] for r in S.expand_index(files, roots).collect()]
    assert sorted(found) == sorted({f"s{k}" for k in range(n)} - inner)


def test_task_project_is_the_longest_name_contained(spark):
    docs = spark.createDataFrame([(1, "fix Project 12, now"), (2, "subproject 1"), (3, "none"), (4, None), (5, "ПРОЕКТ и project 1\nproject 123")], "doc_id long, text string")
    projects = spark.createDataFrame([("Project 1",), ("Project 12",), ("Project 123",), ("Проект",), ("",), (None,)], "name string")
    facts = T.task_facts(docs, projects)
    assert {r["doc_id"]: r["project"] for r in facts.collect()} == {1: "Project 12", 2: "Project 1", 3: None, 4: None, 5: "Project 123"}
    assert "NestedLoop" not in facts._jdf.queryExecution().toString()
