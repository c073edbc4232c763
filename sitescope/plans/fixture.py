"""The audit tables that the registered queries run on, derived from the given tables by arithmetic on their keys.

Each has the same definition as SQL, so that both sides of a comparison start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitescope.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found


def derive(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Spark's reading of a definition over the named tables."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


#: One row a page: response fields, features and description, by residues of page_id.
PAGES = """
SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS site,
  CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 19 = 0 THEN 500 WHEN page_id % 23 = 0 THEN 301 ELSE 200 END AS status_code,
  CASE WHEN page_id % 13 = 0 THEN 'noindex, follow' WHEN page_id % 5 = 0 THEN 'all' ELSE '' END AS robots,
  CASE WHEN page_id % 29 = 0 THEN 'none' ELSE '' END AS x_robots,
  CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 11 = 0 THEN 'https://example.org/other' ELSE url END AS canonical,
  CASE WHEN page_id % 31 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN page_id % 37 = 0 THEN 'timeout' ELSE '' END AS fetch_error,
  CASE WHEN page_id % 9 = 0 THEN '' ELSE substring(regexp_extract(html, '<title>([^<]*)</title>', 1), 1, CAST(10 + page_id % 70 AS INT)) END AS title,
  CASE WHEN page_id % 10 = 3 THEN '' ELSE regexp_extract(html, '<h1>([^<]*)</h1>', 1) END AS h1,
  CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Short text' WHEN 2 THEN concat('Model ', CAST(page_id AS VARCHAR(20)), ' price from ', CAST(page_id % 3 AS VARCHAR(20)), ' with fast delivery and a full guarantee for every order placed')
    WHEN 3 THEN repeat('Long description of a page. ', CAST(1 + page_id % 9 AS INT)) ELSE concat('Questions &amp; answers for everyone, call 8 (912) 345-67-89 or write to us ', CAST(page_id % 2 AS VARCHAR(20))) END AS description,
  CAST(CASE WHEN page_id % 10 = 3 THEN 0 WHEN page_id % 12 = 0 THEN 2 ELSE 1 END AS INT) AS h1_count,
  CAST(page_id % 4 AS INT) AS h2_count, CAST(page_id % 3 AS INT) AS h3_count, CAST(page_id % 6 AS INT) AS paragraphs,
  CAST((page_id * 37) % 1100 AS INT) AS word_count, CAST((page_id * 7) % 6 AS INT) AS internal_links,
  CAST(page_id % 8 AS INT) AS images, CAST(least(page_id % 8, page_id % 3) AS INT) AS missing_alt,
  page_id % 6 = 0 AS has_faq, page_id % 4 <> 0 AS has_cta
FROM {pages}
"""

#: The given pages with what they lack put into head and article, by residues: open graph, structured data (also broken),
#: marks of questions and calls, tables, lists and images.
DRESSED = """
SELECT page_id, url, replace(replace(html, '</head>', concat(
  CASE WHEN page_id % 2 = 0 THEN concat('<meta property="og:title" content="T ', CAST(page_id AS VARCHAR(20)), ' &amp; more">') ELSE '' END, CASE WHEN page_id % 4 = 0 THEN '<meta property="og:title" content="second">' ELSE '' END,
  CASE WHEN page_id % 3 = 1 THEN concat('<meta name="og:image" content="i', CAST(page_id % 7 AS VARCHAR(20)), '.png">') ELSE '' END, CASE WHEN page_id % 5 = 2 THEN '<meta property="OG:description" content="  some   text ">' ELSE '' END,
  CASE WHEN page_id % 7 = 3 THEN '<script type="application/ld+json">{{"@type": "Product", </script>' WHEN page_id % 3 = 2 THEN '' ELSE concat('<script type="application/ld+json">{{"@graph":[{{"@type":"', CASE WHEN page_id % 3 = 0 THEN 'Product' ELSE 'Article' END,
    '","name":"N', CAST(page_id AS VARCHAR(20)), '","sku":"S', CAST(page_id AS VARCHAR(20)), '","brand":{{"name":"B"}}}},{{"@type":["Thing","', CASE WHEN page_id % 2 = 0 THEN 'ItemList' ELSE 'Person' END, '"]}}]}}</script>') END, '</head>')),
  '</article>', concat(CASE WHEN page_id % 5 = 0 THEN '<div class="my-Accordion">more</div>' WHEN page_id % 7 = 1 THEN '<div itemtype="https://schema.org/FAQPage"></div>' ELSE '' END,
    CASE WHEN page_id % 3 = 0 THEN '<button> ЗАКАЗАТЬ сейчас</button>' WHEN page_id % 11 = 2 THEN '<form></form>' ELSE '' END,
    '<table><tr><td>Weight</td><td>', CAST(page_id AS VARCHAR(20)), ' kg</td></tr></table><dl><dt>Color</dt><dd>red</dd></dl>',
    CASE WHEN page_id % 4 = 3 THEN '' ELSE concat('<img src="/a', CAST(page_id AS VARCHAR(20)), '.png" alt=" x  y "><img data-src="b.jpg" width="10" height="20px"><img>') END, '</article>')) AS html FROM {pages}
"""

#: Addresses in many spellings with what came back: types of content, and HTML that is a page or is none.
FETCHED = """
SELECT page_id, site, url, CASE WHEN page_id % 9 = 0 THEN 'application/pdf' WHEN page_id % 9 = 1 THEN '' ELSE 'text/HTML' END AS content_type,
  CASE page_id % 4 WHEN 0 THEN '<h1>x</h1>' WHEN 1 THEN 'plain <!-- <body> --> words<script>var x = "a long script that is no text of a page, whatever it says, and goes on for more than a hundred characters";</script>'
    WHEN 2 THEN repeat('many words ', 12) ELSE '<BODY></BODY>' END AS html FROM (URLS) u
"""

#: One row an image on a page.
IMAGES = """
SELECT p.page_id, p.url AS page_url, lower(regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1)) AS site, CAST(k.n_nationkey + 1 AS INT) AS idx,
  concat('https://cdn.example.com/i', CAST((p.page_id * 3 + k.n_nationkey) % 40 AS VARCHAR(20)), CASE WHEN (p.page_id + k.n_nationkey) % 3 = 0 THEN '.webp' ELSE '.jpg' END) AS src,
  CASE (p.page_id + k.n_nationkey) % 4 WHEN 0 THEN '' WHEN 1 THEN 'Logo' WHEN 2 THEN 'logo' ELSE concat('picture ', CAST(p.page_id % 30 AS VARCHAR(20))) END AS alt,
  (p.page_id + k.n_nationkey) % 8 <> 0 AS has_alt,
  CASE WHEN (p.page_id + k.n_nationkey) % 5 = 0 THEN NULL ELSE 640 END AS width, CASE WHEN (p.page_id + k.n_nationkey) % 6 = 0 THEN NULL ELSE 480 END AS height
FROM {pages} p JOIN {nation} k ON k.n_nationkey < 1 + p.page_id % 4
"""

#: What is known about image files.
IMAGE_META = """
SELECT concat('https://cdn.example.com/i', CAST(n AS VARCHAR(20)), e) AS src, CAST(CASE WHEN n % 9 = 0 THEN 404 ELSE 200 END AS INT) AS status_code, n * 60000 AS size_bytes
FROM (SELECT DISTINCT page_id % 40 AS n FROM {pages}) a CROSS JOIN (SELECT '.jpg' AS e UNION ALL SELECT '.webp' AS e) b
"""

#: Pages of a site numbered in order of id; the first is its home page. There are more sites the more pages there are.
RANKED = """
SELECT page_id, url, site, status_code, title, h1, row_number() OVER (PARTITION BY site ORDER BY page_id) AS rn, concat(site, '#', CAST(row_number() OVER (PARTITION BY site ORDER BY page_id) AS VARCHAR(20))) AS key
FROM (SELECT page_id, url, concat('s', CAST(page_id % (SELECT 7 + CAST(floor(count(*) / 250.0) AS BIGINT) FROM {pages}) AS VARCHAR(20))) AS site, CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 23 = 0 THEN 301 ELSE 200 END AS status_code,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM {pages}) t
"""

#: How many sites RANKED has.
SITES = "(SELECT 7 + CAST(floor(count(*) / 250.0) AS BIGINT) FROM {pages})"


def seven(text: str) -> str:
    """A definition, or its SQL, with seven sites whatever the number of pages: each site grows with the table."""
    return text.replace(SITES, "7").replace(sql(SITES), "7")


#: Links: a binary tree over each site's pages (with gaps), self-links, home links, links to unknown pages, and repeats.
LINKS = """
WITH r AS (%s), k AS (SELECT n_nationkey AS j FROM {nation} WHERE n_nationkey < 5)
SELECT site, key AS src_key, dst AS dst_key, anchor, link_type, pos FROM (
  SELECT r.site, r.key, k.j + 1 AS pos,
    CASE k.j WHEN 0 THEN concat(r.site, '#', CAST(2 * r.rn AS VARCHAR(20))) WHEN 1 THEN concat(r.site, '#', CAST(2 * r.rn + 1 AS VARCHAR(20)))
      WHEN 2 THEN r.key WHEN 3 THEN concat(r.site, '#1') ELSE concat(r.site, '#', CAST(2 * r.rn AS VARCHAR(20))) END AS dst,
    concat('to ', CAST((r.rn + k.j) %% 4 AS VARCHAR(20))) AS anchor,
    CASE k.j WHEN 3 THEN 'menu' WHEN 1 THEN 'hub' ELSE 'content' END AS link_type,
    CASE k.j WHEN 2 THEN r.rn %% 5 = 0 WHEN 3 THEN r.rn %% 3 = 0 WHEN 4 THEN r.rn %% 4 = 0 WHEN 1 THEN r.rn %% 11 <> 3 ELSE r.rn %% 13 <> 5 END AS there
  FROM r CROSS JOIN k) t WHERE there
""" % RANKED

#: URLs in many spellings.
URLS = """
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS site, CASE page_id % 12 WHEN 0 THEN url WHEN 1 THEN concat('  ', url, ' ') WHEN 2 THEN regexp_replace(url, '^https?://', '')
  WHEN 3 THEN concat(regexp_replace(url, '[?#].*$', ''), '?utm_source=x&page=2&gclid=1') WHEN 4 THEN concat(regexp_replace(url, '[?#].*$', ''), '//a_b-c/photo.JPG')
  WHEN 5 THEN regexp_replace(url, '^https?://', 'HTTPS://WWW.') WHEN 6 THEN concat(regexp_replace(url, '[?#].*$', ''), '/wp-content/uploads/x') WHEN 7 THEN concat(regexp_replace(url, '[?#].*$', ''), '/ajax/tab.php?action=1')
  WHEN 8 THEN regexp_replace(url, '^(https?://[^/]*).*$', 'http://catalog.example.com:80/catalog/shoes/red-2/?PAGED=3#x') WHEN 9 THEN concat('https://example.com/blog/post-', CAST(page_id AS VARCHAR(20)), '/')
  WHEN 10 THEN 'not a url' ELSE concat('https://www.example.com/news/google', CAST(page_id AS VARCHAR(20)), '.html') END AS url
FROM {pages}
"""

FETCHED = FETCHED.replace("URLS", URLS)

#: Briefs: figures, keywords and lists follow the item's id and text.
BRIEFS = """
SELECT item_id AS brief_id, concat('**URL:** [https://e.example/p', CAST(item_id % 9 AS VARCHAR(20)), ']\nРекомендуемое количество слов:** ', CAST(300 + item_id % 5 * 100 AS VARCHAR(20)), ' слов',
  CASE WHEN item_id % 3 <> 0 THEN concat(' (', CAST(2000 + item_id % 4 * 500 AS VARCHAR(20)), ' символов)') ELSE '' END, ' - найдено: 10 слов\nДобавьте в текст ключевые слова\n- key ', regexp_extract(text, '[A-Za-z]+', 0), ': 1-3 (найдено: 2)\n',
  CASE WHEN item_id % 2 = 0 THEN '* middle one: 1 - 1\n' ELSE 'no range here\n' END, '- second key: 0 - ', CAST(2 + item_id % 6 AS VARCHAR(20)), '\nДобавьте в текст LSI\n',
  CASE WHEN item_id % 4 = 0 THEN '- alpha\n- beta\n' ELSE concat('• gamma ', CAST(item_id % 10 AS VARCHAR(20)), '\n') END, 'Структура статьи\nГлавное ключевое слово:** main ', CAST(item_id % 11 AS VARCHAR(20)), '\nДополнительные ключевые слова:\n',
  CASE WHEN item_id % 5 = 0 THEN '- x\n- y' ELSE concat('- z', CAST(item_id % 3 AS VARCHAR(20))) END) AS text
FROM {benchmark}
"""

#: What briefs ask of texts: phrases from the item's first three words, which overlap, and two common ones.
REQUIREMENTS = """
SELECT item_id AS brief_id, CAST(k AS INT) AS requirement, CASE k WHEN 0 THEN w1 WHEN 1 THEN concat(w2, ' ', w3) WHEN 2 THEN concat(w1, ' ', w2, ' ', w3) WHEN 3 THEN 'the' ELSE 'Of the' END AS phrase,
  CAST((item_id + k) % 3 AS INT) AS min, CAST((item_id + k) % 3 + 2 + item_id % 4 AS INT) AS max
FROM (SELECT item_id, regexp_extract(text, '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', 1) AS w1, regexp_extract(text, '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', 2) AS w2,
  regexp_extract(text, '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', 3) AS w3 FROM {benchmark}) b CROSS JOIN (SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 5) n
"""

#: Further phrases that a brief wants to see once.
LSI = """
SELECT item_id AS brief_id, CAST(k AS INT) AS requirement, CASE k WHEN 0 THEN regexp_extract(text, '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', 2) WHEN 1 THEN 'with' ELSE regexp_extract(text, '([A-Za-z]+) ([A-Za-z]+)', 0) END AS phrase
FROM {benchmark} CROSS JOIN (SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 3) n
"""

#: A brief's figures; some have none for characters, some for neither.
TARGETS = "SELECT item_id AS brief_id, CASE WHEN item_id % 7 <> 5 THEN 100 + item_id % 5 * 100 END AS words, CASE WHEN item_id % 3 <> 0 THEN 1000 + item_id % 4 * 500 END AS chars FROM {benchmark}"

#: Documents and their briefs; the last number stands for no brief.
BRIEFED = "SELECT doc_id, doc_id % (SELECT count(*) + 1 FROM {benchmark}) AS brief_id, text FROM {documents}"

#: Documents with two sentences of Russian word forms at the end: a root and two endings follow the document's id.
RUSSIAN = """
SELECT doc_id, concat(coalesce(text, ''), '. ', r, e1, ' большой ', r, e2, ' стоит рядом 12. ', r, e2, ' Большая ', r, e1, ' СТОЯТ рядом.') AS text FROM (SELECT doc_id, text,
  split_part('насос вод ёлк строительств красн работ читал помога сто бежа длинн новост нежност умнейш быстр принес дел камен', ' ', CAST(1 + doc_id % 18 AS INT)) AS r,
  split_part('а ами ая ев ее ей ейше ем ение ет ешь ёт и ив ивши ившись ие ий ила ими ит ить ия ла ли лся ми на нный нно о ов ого ой ом ост ость оть ою ся т те ть ться у уют ущий ую ы ый ым ыми ых ь ью ю ют ющая юся я ям ями ях яя вши вшись в ем емый', ' ', CAST(1 + (doc_id * 7) % 69 AS INT)) AS e1,
  split_part('ы ого ами ющийся ованная евшими остью нн нный ейший ь', ' ', CAST(1 + (doc_id * 3) % 11 AS INT)) AS e2 FROM {documents}) d
"""

#: Task texts: which lines a text has, and what they say, follows its document's id.
TASK_TEXTS = """
SELECT doc_id, concat(
  CASE WHEN doc_id % 4 = 1 THEN '' ELSE concat('ТЗ № ', CAST(doc_id AS VARCHAR(20)), '\n') END,
  CASE WHEN doc_id % 3 = 0 THEN concat('Цели ТЗ:\ngrow by ', CAST(doc_id % 7 AS VARCHAR(20)), '\n') ELSE 'about the site\n' END,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Задачи для разработчика\n' WHEN 2 THEN 'Список для SEO-специалиста\n' WHEN 3 THEN 'Задача: дизайнер\n' ELSE 'разработчик\n' END,
  '1. Добавить ссылки на /catalog/p', CAST(doc_id % 9 AS VARCHAR(20)), ' • \n  проблема: slow ', CAST(doc_id % 5 AS VARCHAR(20)), '\n',
  CASE WHEN doc_id % 2 = 0 THEN 'решение: cache it\nисправить canonical\nпример: as before\n' ELSE 'plain words\n\n' END,
  CASE WHEN doc_id % 6 = 0 THEN 'План.PDF\n' ELSE '' END,
  '2) ', CASE doc_id % 4 WHEN 0 THEN 'P1 ' WHEN 1 THEN 'p3, ' ELSE '' END, 'fix menu for Project ', CAST(doc_id * 7919 % (SELECT count(*) FROM {customer}) + 1 AS VARCHAR(20)),
  CASE doc_id % 4 WHEN 0 THEN ', срок: 20.04.2024' WHEN 1 THEN ' до 3.05' WHEN 2 THEN ' завтра' ELSE '' END, '\n',
  CASE WHEN doc_id % 7 < 3 THEN concat('see https://e.example/', CAST(doc_id % 3 AS VARCHAR(20)), ', https://e.example/b\n') ELSE '' END,
  'Настройка sitemap:\nпроверить alt\n',
  CASE WHEN doc_id % 3 = 1 THEN 'Ожидаемый результат: fast pages\nmore visits\n3. not a task\n' ELSE '' END,
  CASE WHEN doc_id % 8 = 5 THEN 'Задачи для контент-менеджера\nНовые тексты:\nнаписать анонс\n' ELSE '' END) AS text
FROM {documents}
"""

PROJECTS = "SELECT c_custkey AS project_id, concat('Project ', CAST(c_custkey AS VARCHAR(20))) AS name, concat('site', CAST(c_custkey AS VARCHAR(20)), '.example.com') AS domain FROM {customer}"

#: Audits: one row an order.
AUDITS = """
SELECT o_orderkey AS id, o_custkey AS project_id, CAST(floor(o_totalprice) AS BIGINT) % 101 AS score, o_orderdate AS created_at, o_orderkey % 50 AS pages_total, o_orderkey % 7 AS critical,
  o_orderkey % 11 AS warnings FROM {orders}
"""

#: Saved tasks: one row an order.
TASKS = """
SELECT o_orderkey AS id, concat('Task ', CAST(o_orderkey AS VARCHAR(20))) AS title, o_custkey AS project_id, CASE o_orderkey % 3 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' ELSE 'P3' END AS priority,
  CASE o_orderkey % 5 WHEN 0 THEN '2024-03-15' WHEN 1 THEN '15.03.2024' WHEN 2 THEN '15/03/2024' WHEN 3 THEN 'until 20.04.2024 please' ELSE '' END AS deadline,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'new' ELSE 'in_progress' END AS status, CASE WHEN o_orderkey % 6 = 0 THEN concat('seo:', CAST(o_custkey AS VARCHAR(20))) ELSE concat('file', CAST(o_orderkey AS VARCHAR(20))) END AS source_name,
  o_orderdate AS updated_at, o_orderkey % 4 AS n_items, o_orderkey % 3 AS n_qa, o_orderkey % 5 AS n_done FROM {orders}
"""

#: Memory events: one row an event.
EVENTS = "SELECT event_id AS id, user_id AS project_id, event_type AS kind, CAST(event_id AS VARCHAR(20)) AS title, ts AS created_at, event_type AS state_key, value FROM {events}"


def sql(text: str) -> str:
    """A definition for an engine where the tables are views."""
    import re

    return re.sub(r"\{(\w+)\}", r"\1", text).replace("{{", "{").replace("}}", "}")
