"""Queries over parsed pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.functions import html as H
from sitescope.functions import urls as U
from sitescope.plans import fixture as X


def parsed(spark, sf_dir):
    return H.parse(X.table(spark, sf_dir, "pages"))


def dressed(spark, sf_dir):
    return H.parse(X.derive(spark, sf_dir, X.DRESSED, "pages"))


def h01_features(spark, sf_dir):
    p = parsed(spark, sf_dir)
    return p.select("page_id", "title", "h1", "h1_count", "h2_count", "h3_count", "paragraphs", "word_count", "body_word_count", "has_faq", "has_cta", F.size("links").alias("n_links"), F.size("images").alias("n_images"))


def h02_heads(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", "title", "description", "robots", "canonical", "h1", F.size("h1_all").cast("long").alias("n_h1"))


def h03_headings(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", *(F.col(c).cast("long").alias(c) for c in ("h1_count", "h2_count", "h3_count")))


def h04_visible_words(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", F.col("word_count").cast("long").alias("word_count"))


def h05_body_words(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", F.col("body_word_count").cast("long").alias("body_word_count"))


def h06_link_counts(spark, sf_dir):
    return H.link_counts(parsed(spark, sf_dir)).select("page_id", *(F.col(c).cast("long").alias(c) for c in ("internal", "external", "empty")))


def h07_faq(spark, sf_dir):
    return dressed(spark, sf_dir).select("page_id", "has_faq")


def h08_cta(spark, sf_dir):
    return dressed(spark, sf_dir).select("page_id", "has_cta")


def h09_open_graph(spark, sf_dir):
    return dressed(spark, sf_dir).select("page_id", *(F.get("og", F.lit(k)).alias(n) for k, n in enumerate(("og_title", "og_description", "og_image"))))


def h10_raw_description(spark, sf_dir):
    """Over pages with a description tag put in: both orders of the attributes."""
    d = X.derive(spark, sf_dir, X.PAGES, "pages")
    tag = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta name="description" content="'), "description", F.lit('">'))).otherwise(F.concat(F.lit('<meta content="'), "description", F.lit('" name="description">')))
    pages = d.select("page_id", "url", F.concat(F.lit("<html><head>"), tag, F.lit("</head><body></body></html>")).alias("html"))
    return H.parse(pages).select("page_id", "description_raw")


def h11_unescaped_description(spark, sf_dir):
    d = X.derive(spark, sf_dir, X.PAGES, "pages")
    pages = d.select("page_id", "url", F.concat(F.lit('<meta name="description" content="'), "description", F.lit('">')).alias("html"))
    return H.parse(pages).select("page_id", "description")


def h12_jsonld(spark, sf_dir):
    return dressed(spark, sf_dir).select("page_id", F.array_join("jsonld", ",").alias("types"))


def h13_product_facts(spark, sf_dir):
    p = dressed(spark, sf_dir)
    return p.select("page_id", F.col("product.name").alias("name"), F.posexplode_outer("product.facts").alias("pos", "fact")).select("page_id", "name", F.col("pos").cast("long").alias("pos"), "fact.label", "fact.value")


def h14_page_type(spark, sf_dir):
    return H.page_type(H.parse(X.derive(spark, sf_dir, X.FETCHED, "pages"))).select("page_id", "page_type")


def h15_links(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", F.posexplode("links").alias("pos", "l")).select("page_id", F.col("pos").cast("long").alias("pos"), F.col("l.raw").alias("href"), F.col("l.anchor").alias("anchor"), F.col("l.type").alias("link_type"))


def h16_images(spark, sf_dir):
    images = dressed(spark, sf_dir).select("page_id", F.explode("images").alias("i"))
    return images.select("page_id", F.col("i.idx").cast("long").alias("idx"), "i.src", "i.alt", "i.has_alt", F.col("i.width").cast("long").alias("width"), F.col("i.height").cast("long").alias("height"))


def h17_main_text(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", F.length("main_text").cast("long").alias("chars"), F.expr("startswith(main_text, h1)").alias("starts_with_h1"))


def h18_keywords(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", F.posexplode("keywords").alias("pos", "keyword"))


_ALL = (h01_features, h02_heads, h03_headings, h04_visible_words, h05_body_words, h06_link_counts, h07_faq, h08_cta, h09_open_graph, h10_raw_description, h11_unescaped_description, h12_jsonld, h13_product_facts, h14_page_type, h15_links, h16_images, h17_main_text, h18_keywords)
QUERIES = {f.__name__: f for f in _ALL}
_UN = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_CLEAN = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_TITLE = _CLEAN(_UN("regexp_extract(html, '<title>([^<]*)</title>', 1)"))
_H1 = _CLEAN(_UN("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))
_STRIP = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), {drop}'<[^>]*>', ' ', 'g')"
_WORDS = lambda x: f"len(regexp_extract_all({x}, '[A-Za-zА-Яа-яЁё0-9]+'))"
_BODY = "regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g')"
_DROPPED = f"regexp_replace({_BODY}, '(?s)<nav>.*?</nav>|<footer>.*?</footer>|<footer>.*$', ' ', 'g')"
_D = X.sql(X.PAGES)
ORACLE_SQL = {
    "h18_keywords": f"""WITH w AS (SELECT page_id, regexp_extract_all(lower(({_CLEAN(_UN('regexp_replace(' + _DROPPED + ", '<[^>]*>', ' ', 'g')"))})[1:12000]), '[a-zа-яё0-9]{{3,}}') AS w FROM pages),
      c AS (SELECT page_id, word, count(*) AS n, min(k) AS k FROM (SELECT page_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM w) u GROUP BY 1, 2),
      t AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, k) AS r FROM c),
      f AS (SELECT page_id, word, row_number() OVER (PARTITION BY page_id ORDER BY r) - 1 AS pos FROM t WHERE r <= 80 AND word NOT IN ({", ".join(f"'{x}'" for x in sorted(H.STOPWORDS))}) AND NOT regexp_matches(word, '^[0-9]+$'))
      SELECT page_id, pos, word AS keyword FROM f WHERE pos < 35""",
    "h02_heads": f"SELECT page_id, {_TITLE} AS title, '' AS description, '' AS robots, '' AS canonical, {_H1} AS h1, CAST(len(regexp_extract_all(html, '<h1>')) AS BIGINT) AS n_h1 FROM pages",
    "h03_headings": "SELECT page_id, CAST(len(regexp_extract_all(html, '<h1>')) AS BIGINT) AS h1_count, CAST(len(regexp_extract_all(html, '<h2>')) AS BIGINT) AS h2_count, CAST(len(regexp_extract_all(html, '<h3>')) AS BIGINT) AS h3_count FROM pages",
    "h04_visible_words": f"SELECT page_id, CAST({_WORDS(_UN(f'regexp_replace({_BODY}, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')'))} AS BIGINT) AS word_count FROM pages",
    "h05_body_words": f"SELECT page_id, CAST({_WORDS(_UN(f'regexp_replace({_DROPPED}, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')'))} AS BIGINT) AS body_word_count FROM pages",
    "h06_link_counts": "SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1))) AS BIGINT) AS internal, CAST(0 AS BIGINT) AS external, CAST(0 AS BIGINT) AS empty FROM pages",
    "h07_faq": "SELECT page_id, contains(lower(html), 'faq') OR page_id % 5 = 0 OR page_id % 7 = 1 AS has_faq FROM pages",
    "h08_cta": "SELECT page_id, contains(html, '<form') OR page_id % 3 = 0 OR page_id % 11 = 2 AS has_cta FROM pages",
    "h09_open_graph": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'T ' || page_id || ' & more' ELSE '' END AS og_title, CASE WHEN page_id % 5 = 2 THEN 'some text' ELSE '' END AS og_description, CASE WHEN page_id % 3 = 1 THEN 'i' || page_id % 7 || '.png' ELSE '' END AS og_image FROM pages",
    "h10_raw_description": f"SELECT page_id, {_CLEAN('description')} AS description_raw FROM ({_D}) t",
    "h11_unescaped_description": f"SELECT page_id, {_CLEAN(_UN('description'))} AS description FROM ({_D}) t",
    "h12_jsonld": "SELECT page_id, CASE WHEN page_id % 7 = 3 OR page_id % 3 = 2 THEN '' ELSE array_to_string(list_sort([CASE WHEN page_id % 3 = 0 THEN 'product' ELSE 'article' END, CASE WHEN page_id % 2 = 0 THEN 'itemlist' ELSE 'person' END, 'thing']), ',') END AS types FROM pages",
    "h13_product_facts": f"""SELECT page_id, CASE WHEN p THEN 'N' || page_id ELSE {_H1} END AS name, CAST(CASE WHEN p THEN pos END AS BIGINT) AS pos, CASE WHEN p THEN label END AS label, CASE WHEN NOT p THEN NULL WHEN pos = 0 THEN 'S' || page_id WHEN pos = 2 THEN page_id || ' kg' ELSE value END AS value
      FROM (SELECT *, page_id % 3 = 0 AND page_id % 7 <> 3 AS p FROM pages) x JOIN (VALUES (0, 'Артикул', ''), (1, 'Производитель', 'B'), (2, 'Weight', ''), (3, 'Color', 'red')) v(pos, label, value) ON p OR pos = 0""",
    "h14_page_type": f"""SELECT page_id, CASE WHEN page_id % 9 = 0 OR page_id % 4 = 1 OR regexp_matches(url, '/ajax/|/google[0-9]+[.]html') THEN 'technical' WHEN regexp_matches(url, '/blog/.') OR regexp_matches(url, '/news/.') THEN 'article'
      ELSE 'unknown' END AS page_type FROM ({X.sql(X.FETCHED)}) t""",
    "h15_links": rf"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) - 1 AS pos FROM pages)
      SELECT page_id, pos, {_CLEAN(_UN("regexp_extract(a, 'href=\"([^\"]*)\"', 1)"))} AS href, {_CLEAN(_UN("regexp_extract(a, '>([^<]*)<', 1)"))} AS anchor, 'menu' AS link_type FROM l""",
    "h16_images": "SELECT page_id, CAST(idx AS BIGINT) AS idx, CASE idx WHEN 1 THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || '/a' || page_id || '.png' WHEN 2 THEN regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || 'b.jpg' ELSE '' END AS src, CASE idx WHEN 1 THEN 'x y' ELSE '' END AS alt, idx = 1 AS has_alt, CASE WHEN idx = 2 THEN CAST(10 AS BIGINT) END AS width, CAST(NULL AS BIGINT) AS height FROM pages CROSS JOIN (VALUES (1), (2), (3)) v(idx) WHERE page_id % 4 <> 3",
}
