"""Queries from the HTML of fetched pages to issues, summaries and the link graph, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.operators import links as L
from sitescope.operators import siteaudit as A
from sitescope.plans import audit, html, linking
from sitescope.plans import fixture as X
from sitescope.sources import io as S
from sitescope.sources.tables import settled


def snapshot(spark, sf_dir):
    return S.with_defaults(X.table(spark, sf_dir, "pages"))


def graph(spark, sf_dir):
    """(pages, links, homes), each settled, as several joins read them; a site's home is its page of least id."""
    pages, links = (settled(x) for x in L.html_graph(snapshot(spark, sf_dir)))
    first = pages.groupBy("site").agg(F.min_by("key", "page_id").alias("key"))
    return pages, links, first


def e01_html_issues(spark, sf_dir):
    """Page by page: the issues that titles, headings, words and links of the HTML raise, and what they cost."""
    found = A.audit_html(snapshot(spark, sf_dir)).withColumn("core", A.core_issues())
    return found.select("page_id", F.array_join(F.transform("core", lambda i: F.concat(i["code"], F.lit(":"), i["severity"])), ",").alias("issues"), F.col("score").cast("long").alias("score"))


def e02_html_summary(spark, sf_dir):
    """Site by site, with duplicates among the pages."""
    found = settled(A.audit_html(snapshot(spark, sf_dir)).select("site", "url", "status_code", "failed", "score", "content_score", "has_faq", "has_cta", "title", "h1", "description"))
    doubled = A.all_duplicates(found).groupBy("site").agg(F.count_if(F.col("code") == "duplicate_title").alias("duplicate_titles"), F.count_if(F.col("code") == "duplicate_h1").alias("duplicate_h1"))
    both = A.site_summary(found).join(doubled, "site", "left").na.fill(0, ["duplicate_titles", "duplicate_h1"])
    return both.select("site", "pages", "success", "score", "no_faq", "no_cta", "limited", "duplicate_titles", "duplicate_h1")


def e03_html_link_status(spark, sf_dir):
    """Site by site: distinct links within the site, and those that lead to no known page."""
    pages, links, _ = graph(spark, sf_dir)
    status = pages.select("site", F.col("key").alias("dst_key"), "status_code", F.lit("").alias("redirect_to"))
    return L.link_status(L.edges(links), status).groupBy("site").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("kind") == "broken").alias("broken"))


def e04_html_metrics(spark, sf_dir):
    """Page by page: inlinks, outlinks, click depth and flags."""
    return L.page_metrics(*graph(spark, sf_dir)).select("site", "key", "incoming", "outgoing", "depth", "orphan", "weak", "no_outgoing", "unreachable", "deep")


_ALL = (e01_html_issues, e02_html_summary, e03_html_link_status, e04_html_metrics)
QUERIES = {f.__name__: f for f in _ALL}

_HREFS = """list_distinct(regexp_extract_all(html, '<a href="(/[^"]*)"', 1))"""
_FEATURES = f"""SELECT p.page_id, url, split_part(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', ''), ':', 1) AS site, 200 AS status_code, 'text/html' AS content_type, '' AS fetch_error, '' AS robots, '' AS canonical,
  title, '' AS description, h1, CAST(n_h1 AS INT) AS h1_count, CAST(h2_count AS INT) AS h2_count, CAST(h3_count AS INT) AS h3_count, 0 AS paragraphs, CAST(word_count AS INT) AS word_count, CAST(len({_HREFS}) AS INT) AS internal_links, 0 AS images, 0 AS missing_alt, has_faq, has_cta
  FROM pages p JOIN ({html.ORACLE_SQL["h02_heads"]}) a USING (page_id) JOIN ({html.ORACLE_SQL["h03_headings"]}) b USING (page_id) JOIN ({html.ORACLE_SQL["h04_visible_words"]}) c USING (page_id) JOIN (SELECT page_id, contains(lower(html), 'faq') AS has_faq, contains(html, '<form') AS has_cta FROM pages) d USING (page_id)"""
_BASE = audit._BASE.replace(X.sql(X.PAGES), _FEATURES)
_GRAPH = f"""WITH RECURSIVE kp AS (SELECT site, key, min(page_id) AS page_id FROM (SELECT page_id, split_part(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', ''), ':', 1) AS site, {linking._PAGE_KEY('url')} AS key FROM pages) q GROUP BY 1, 2),
  ed AS (SELECT DISTINCT regexp_replace(split_part(src_key, '/', 3), '^www[.]', '') AS site, src_key, dst_key FROM ({linking.ORACLE_SQL["l01_outgoing_links"]}) l WHERE src_key <> dst_key),
  inn AS (SELECT dst_key AS key, count(*) AS incoming FROM ed JOIN kp ON kp.key = ed.src_key GROUP BY 1), ou AS (SELECT src_key AS key, count(*) AS outgoing FROM ed JOIN kp ON kp.key = ed.dst_key GROUP BY 1),
  hm AS (SELECT site, min_by(key, page_id) AS key FROM kp GROUP BY 1),
  bfs AS (SELECT key, 0 AS depth FROM hm UNION SELECT kp.key, b.depth + 1 FROM bfs b JOIN ed ON ed.src_key = b.key JOIN kp ON kp.key = ed.dst_key WHERE b.depth < 20), dep AS (SELECT key, min(depth) AS depth FROM bfs GROUP BY 1) """
ORACLE_SQL = {
    "e01_html_issues": _BASE + "SELECT page_id, array_to_string(core, ',') AS issues, score FROM aud",
    "e02_html_summary": _BASE
    + f""", dt AS (SELECT site, count(*) AS n FROM (SELECT site, count(*) OVER (PARTITION BY site, {audit._CL('title')}) AS n FROM aud WHERE title <> '') x WHERE n > 1 GROUP BY 1),
      dh AS (SELECT site, count(*) AS n FROM (SELECT site, count(*) OVER (PARTITION BY site, {audit._CL('h1')}) AS n FROM aud WHERE h1 <> '') x WHERE n > 1 GROUP BY 1)
      SELECT aud.site, count(*) AS pages, count(*) AS success, CAST(round_even(avg(score), 0) AS BIGINT) AS score, count(*) FILTER (WHERE NOT has_faq) AS no_faq, count(*) FILTER (WHERE NOT has_cta) AS no_cta, count(*) >= 500 AS limited,
      coalesce(any_value(dt.n), 0) AS duplicate_titles, coalesce(any_value(dh.n), 0) AS duplicate_h1 FROM aud LEFT JOIN dt ON dt.site = aud.site LEFT JOIN dh ON dh.site = aud.site GROUP BY 1""",
    "e03_html_link_status": _GRAPH + "SELECT ed.site, count(*) AS links, count(*) FILTER (WHERE kp.key IS NULL) AS broken FROM ed LEFT JOIN kp ON kp.key = ed.dst_key GROUP BY 1",
    "e04_html_metrics": _GRAPH + """SELECT kp.site, kp.key, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing, depth, hm.key IS NULL AND incoming IS NULL AS orphan, hm.key IS NULL AND coalesce(incoming, 0) = 1 AS weak, outgoing IS NULL AS no_outgoing,
      hm.key IS NULL AND depth IS NULL AS unreachable, coalesce(depth >= 4, false) AS deep FROM kp LEFT JOIN inn ON inn.key = kp.key LEFT JOIN ou ON ou.key = kp.key LEFT JOIN dep ON dep.key = kp.key LEFT JOIN hm ON hm.key = kp.key""",
}
