"""Nulls, empty tables, ties and repeated rows in the library's operators; the stream's state over several batches."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from sitescope.functions import html as H
from sitescope.functions import urls as U
from sitescope.operators import links as L
from sitescope.operators import siteaudit as A
from sitescope.operators import texts as T
from sitescope.sources import io as S
from sitescope.sources import tables
from sitescope.streaming import state

PAGES = "page_id long, url string, html string, title string"


def test_audit_of_odd_pages(spark):
    good = "<html><head><title>t</title></head><body><h1>x</h1><a href='/b'>b</a><img src='i.png' alt=''></body></html>"
    rows = [(1, "https://e.ru/a", None, "old"), (2, "https://e.ru/b", "", None), (3, "https://e.ru/c", good, "old"), (3, "https://e.ru/c", good, "old"), (None, None, "<p>", None)]
    pages = S.with_defaults(spark.createDataFrame(rows, PAGES))
    got = A.audit_html(pages).collect()
    assert len(got) == 5 and sorted((r["page_id"], r["title"], r["missing_alt"]) for r in got if r["page_id"]) == [(1, "", 0), (2, "", 0), (3, "t", 1), (3, "t", 1)]
    assert A.site_summary(A.audit_html(pages)).where("site = 'e.ru'").first()["pages"] == 4
    assert {(r["code"], r["n"]) for r in A.all_duplicates(A.audit_html(pages)).collect()} == {("duplicate_title", 2), ("duplicate_h1", 2)}
    assert A.site_summary(A.audit_html(pages.limit(0))).count() == 0
    assert H.parse(pages).columns.count("title") == 1


def test_link_graph_of_odd_pages(spark):
    pages = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), (None, None)], "site string, key string")
    links = spark.createDataFrame([("s", "a", "b", "x", "menu", 1), ("s", "a", "b", "x", "menu", 1), ("s", "a", "a", "x", "menu", 2), ("s", None, "c", None, "hub", 1)], "site string, src_key string, dst_key string, anchor string, link_type string, pos int")
    homes = pages.where("key = 'a'")
    got = {r["key"]: r for r in L.page_metrics(pages, links, homes).collect()}
    assert (got["a"]["outgoing"], got["b"]["incoming"], got["b"]["depth"], got["c"]["orphan"], got["c"]["unreachable"]) == (1, 1, 1, True, True)
    assert L.page_metrics(pages.limit(0), links, homes.limit(0)).count() == 0
    assert all(r["orphan"] or r["key"] == "a" for r in L.page_metrics(pages, links.limit(0), homes).where("key is not null").collect())


@pytest.mark.parametrize(("frequent", "vocabulary"), [(200, 60), (5, 60), (1, 12), (0, 6)])
def test_donors_against_all_pairs(spark, frequent, vocabulary):
    """From an index of rare tokens alone to lists of classes alone."""
    rnd = random.Random(3 + frequent)
    words = [f"w{k}" for k in range(vocabulary)]
    rows = [("s", f"k{k:03}", "/" + "/".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3))), rnd.sample(words, rnd.randint(0, 3)), rnd.randint(0, 30), rnd.choice([200, 200, 404])) for k in range(120)]
    pages = spark.createDataFrame(rows, "site string, key string, path string, tokens array<string>, outgoing int, status_code int")
    edge = [("s", f"k{a:03}", f"k{b:03}") for a, b in {(rnd.randrange(120), rnd.randrange(120)) for _ in range(150)}]
    targets = [r[1] for r in rows[:40]]
    got = collections.defaultdict(list)
    for r in L.suggest_donors(spark.createDataFrame([("s", t) for t in targets], "site string, key string"), pages, spark.createDataFrame(edge, "site string, src_key string, dst_key string"), frequent=frequent).collect():
        got[r["target"]].append((r["rank"], r["donor"], r["overlap"], r["reason"]))
    linked = {(b, a) for _, a, b in edge}
    for _, t, path, tokens, _, _ in rows[:40]:
        ranked = []
        for _, d, other, more, out, status in rows:
            if d == t or status != 200 or (t, d) in linked:
                continue
            both = sorted(set(tokens) & set(more))
            prefix = 0
            for x, y in zip(path.strip("/").split("/"), other.strip("/").split("/")):
                if x != y:
                    break
                prefix += 1
            if both or prefix:
                score = len(both) / max(1, len(set(tokens) | set(more))) * 100 + 8 * prefix + min(out, 20) * 0.15
                ranked.append((-round(score, 9), d, len(both), "общие темы: " + ", ".join(both[:4]) if both else "близкая ветка структуры сайта"))
        want = [(k + 1, *x[1:]) for k, x in enumerate(sorted(ranked)[:3])]
        assert sorted(got[t]) == want


def jobs(spark, run):
    """How many jobs Spark starts for something."""
    group = f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def chain(spark, n, more=()):
    pages = spark.range(n).select(F.lit("s").alias("site"), F.col("id").cast("string").alias("key"))
    edge = spark.range(n - 1).select(F.lit("s").alias("site"), F.col("id").cast("string").alias("src_key"), (F.col("id") + 1).cast("string").alias("dst_key"))
    if more:
        edge = edge.union(spark.createDataFrame([("s", str(a), str(b)) for a, b in more], edge.schema))
    return pages, edge, pages.where("key = '0'")


def test_depth_of_ten_thousand_pages_in_a_row(spark):
    pages, edge, homes = chain(spark, 10_000)
    found = {}
    used = jobs(spark, lambda: found.update({r["key"]: r["depth"] for r in L.depths(edge, pages, homes).collect()}))
    assert found == {str(k): k for k in range(10_000)}
    assert used < 40, used


def test_depths_against_a_search(spark):
    rnd = random.Random(8)
    for _ in range(3):
        n = 60
        links = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(75)} | {(k, k + 1) for k in range(20, 35)} | {(50, 51), (51, 50), (0, 20)}
        pages = spark.createDataFrame([(s, str(k)) for s in "ab" for k in range(n)], "site string, key string")
        edge = spark.createDataFrame([(s, str(a), str(b)) for s in "ab" for a, b in links] + [("a", "0", "unknown"), ("b", "x", "3")], "site string, src_key string, dst_key string")
        homes = spark.createDataFrame([("a", "0"), ("b", "7")], "site string, key string")
        want = {}
        for site, home in (("a", 0), ("b", 7)):
            depth, level = {home: 0}, [home]
            while level:
                level = sorted({b for a in level for x, b in links if x == a and b not in depth})
                depth.update(dict.fromkeys(level, max(depth.values()) + 1))
            want |= {(site, str(k)): v for k, v in depth.items()}
        assert {(r["site"], r["key"]): r["depth"] for r in L.depths(edge, pages, homes).collect()} == want


def test_exclusions_by_site(spark):
    urls = spark.createDataFrame([("a", "https://a/x/1"), ("a", "https://a/y"), ("b", "https://b/x/1"), (None, None)], "site string, url string")
    rules = spark.createDataFrame([("a", "*/x/*"), (None, "nothing"), ("a", None), ("a", "")], "site string, pattern string")
    assert collections.Counter(r["url"] for r in U.drop_excluded(urls, rules).collect()) == collections.Counter(["https://a/y", "https://b/x/1", None])
    assert U.drop_excluded(urls, rules.limit(0)).count() == 4


def test_texts_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\n \n"), (4, "a b c a b c"), (4, "a b c a b c"), (None, "b c a b c a")], "doc_id long, text string")
    assert sorted(map(tuple, T.repeated_gram(docs, stop=()).where("doc_id is not null").collect())) == [(4, "a b c", 2), (4, "a b c", 2)]
    assert [r["gram"] for r in T.repeated_gram(docs, stop=()).where("doc_id is null").collect()] == ["b c a"]
    assert T.repeated_gram(docs, protected=("a b c",), stop=()).where("doc_id = 4").count() == 0
    assert T.task_lines(docs.where("doc_id < 4")).count() == 0
    projects = spark.createDataFrame([("abc",), (None,), ("",)], "name string")
    facts = {r["doc_id"]: r for r in T.task_facts(docs.where("doc_id < 4"), projects).collect()}
    assert facts[2]["ambiguities"] == "priority,deadline,urls" and facts[2]["project"] is None and len(facts) == 3
    assert T.sentences(docs.limit(0)).count() == 0


def test_url_column_reads_all_rows(spark):
    rows = spark.range(1000).select(F.lit("plain").alias("a"), F.when(F.col("id") >= 300, F.lit("https://e.ru/x")).otherwise("").alias("b"))
    assert S.url_column(rows) == "b" and S.url_column(rows.select("a")) is None and S.url_column(rows.limit(0)) is None


def test_spread_and_small_keep_rows(spark):
    frame = spark.range(100).coalesce(1)
    assert tables.spread(frame).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and tables.spread(frame).count() == 100
    assert tables.small(frame, 10).count() == tables.small(frame, 1000).count() == 100


def test_state_over_batches(spark, tmp_path):
    """Replayed and late events change nothing that they should not; old versions go."""
    rnd = random.Random(4)
    events = [(rnd.randrange(12), rnd.choice("ab"), k, f"t{k}", float(k), f"2024-01-{1 + (k * 7) % 28:02} 00:00:00") for k in range(90)]
    latest = {}
    for cut in (30, 60, 90):
        part = events[cut - 30 : cut] + events[:5]
        spark.createDataFrame(part, "project_id long, state_key string, id long, title string, value double, created_at string").write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("project_id long, state_key string, id long, title string, value double, created_at string").parquet(f"{tmp_path}/in")
        state.start(source, f"{tmp_path}/state", f"{tmp_path}/mark").awaitTermination()
        for e in part:
            latest[e[:2]] = max(latest.get(e[:2], e), e, key=lambda x: (x[5], x[2]))
        got = {(r["project_id"], r["state_key"]): r["id"] for r in state.current(spark, f"{tmp_path}/state").collect()}
        assert got == {k: e[2] for k, e in latest.items()}
    assert max(len(list(p.iterdir())) for p in (tmp_path / "state").glob("part=*")) <= 2


def left_over(spark):
    from pathlib import Path

    return {p.name for p in Path(tables.shared_dir(spark)).glob("table-*")}


def test_state_of_a_stream_without_events(spark, tmp_path):
    """No rows and no error; a stream leaves no folder behind, however many batches it has."""
    schema = "project_id long, state_key string, id long, title string, value double, created_at string"
    (tmp_path / "in").mkdir()
    stream = lambda: state.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", f"{tmp_path}/mark").awaitTermination()
    before = left_over(spark)
    stream()
    assert state.current(spark, f"{tmp_path}/state").collect() == [] and state.current(spark, f"{tmp_path}/state").columns == list(state.COLUMNS)
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{tmp_path}/in")
    for k in range(3):
        spark.createDataFrame([(1, "a", k, "t", 1.0, f"2024-01-0{k + 1}")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream()
    assert [r["id"] for r in state.current(spark, f"{tmp_path}/state").collect()] == [2]
    assert left_over(spark) == before


def test_click_depth_leaves_its_result_alone(spark):
    pages, edge, homes = chain(spark, 30, more=[(3, 20), (9, 20), (25, 1)])
    before = left_over(spark)
    assert L.depths(edge, pages, homes).count() == 30
    assert len(left_over(spark) - before) <= 2  # what the result reads


def test_many_exclusions_of_one_large_site(spark):
    """Against every pattern tried on every address; addresses fetch patterns by rare runs alone."""
    rnd = random.Random(2)
    pieces = ["news", "blog", "a", "cat-1", "shoes", "x.html", "Page", "utm_source=a", "q=1", "[ab]"]
    urls = [(rnd.choice(["big", "big", "big", "small", None]), "https://e.com/" + "/".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 4))) + rnd.choice(["", "?utm_source=a", "?q=1#z"])) for _ in range(300)] + [("big", None)]
    rules = [("big", f"/part-{k}/") for k in range(10_000)] + [("big", "*/news/*"), ("small", "?utm"), (None, "blog*1"), ("big", "*[ab]*x.html"), ("small", "*"), (None, "a?x"), ("big", "q"), ("small", "??"), ("big", "cat-[0-9]"), (None, "["), ("big", " /SHOES/ ")]
    frame, table = spark.createDataFrame(urls, "site string, url string"), spark.createDataFrame(rules, "site string, pattern string")
    few = table.where("pattern not like '/part-%'")
    every = frame.join(few.select(F.col("site").alias("of"), "pattern"), (F.col("of").isNull() | (F.col("of") == F.col("site"))) & U.excludes(F.col("url"), F.col("pattern")), "left_anti")
    got = U.drop_excluded(frame, table)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, every.collect()))
    assert 0 < every.count() < 300 and "NestedLoop" not in U.drop_excluded(frame, table.where("pattern <> '*' and pattern <> '??'"))._jdf.queryExecution().optimizedPlan().toString()


def test_names_through_their_rarest_runs(spark):
    rnd = random.Random(5)
    names = ["Proj", "Project", "Project 1", "Project 12", "ёлка", "Ёлка и сосна", "a", "", None, "x y", "PROJECT 1"] + [f"Name{k}" for k in range(200)]
    texts = [(k, " ".join(rnd.choice(["the", "project", "12", "1", "ЁЛКА", "и", "сосна", "name17", "Name199x", "x", "y"]) for _ in range(rnd.choice([0, 3, 9])))) for k in range(120)]
    texts += [(900, None), (None, "project 12"), (901, "a" * 5000 + "project 12"), (901, "ёлка и сосна")]
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    want = {}
    for i, t in texts:
        for n in names:
            if i is not None and n and n.lower() in (t or "").lower():
                want[i] = max(want.get(i, n), n, key=lambda x: (len(x), x))
    assert {r["doc_id"]: r["name"] for r in T.names_in(docs, table).collect()} == want
    assert T.names_in(docs, table.limit(0)).count() == 0 and T.names_in(docs.limit(0), table).count() == 0


def test_the_title_of_a_task_paper(spark):
    docs = spark.createDataFrame([(1, "Some note\nТЗ № 5 for the site\nТЗ № 5 for the site\nТЗ № 6\nЗадачи для разработчика\n1. fix it"), (2, "a note"), (3, "Задачи для разработчика\n1. fix\nТЗ about it")], "doc_id long, text string")
    kinds = {i: [r["kind"] for r in T.task_lines(docs).where(F.col("doc_id") == i).orderBy("pos").collect()] for i in (1, 2, 3)}
    assert kinds == {1: ["note", "title", "title", "note", "heading", "task"], 2: ["note"], 3: ["heading", "task", "note"]}
