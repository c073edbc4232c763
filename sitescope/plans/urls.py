"""Queries over URL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.functions import urls as U
from sitescope.plans import fixture as X

_AUTH = "regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)"
_SCHEME = "regexp_extract(url, '^([^:/?#]+):', 1)"
_PATH = "regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)"
_HOST = f"regexp_replace(lower({_AUTH}), '^www[.]', '')"
_CPATH = f"regexp_replace(CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END, '/{{2,}}', '/', 'g')"
_KEPT = f"array_to_string(list_transform(list_filter(string_split({_QUERY}, '&'), lambda x: lower(split_part(x, '=', 1)) IN ('page', 'paged', 'pageno', 'page_number')), lambda x: split_part(x, '=', 1) || '=' || split_part(x, '=', 2)), '&')"
_LOWSCHEME = f"lower(CASE WHEN {_SCHEME} = '' THEN 'https' ELSE {_SCHEME} END)"
_TRIMPATH = f"CASE WHEN {_CPATH} = '/' THEN '/' ELSE regexp_replace({_CPATH}, '/+$', '') END"
_NAME = f"list_extract(string_split(lower({_PATH}), '/'), -1)"
_SEGMENTS = f"list_filter(string_split({_PATH}, '/'), lambda x: x <> '')"
_BARE = f"regexp_replace({_PATH}, '^/+|/+$', '', 'g')"
_ASSETS = ", ".join(f"'{x}'" for x in U.ASSETS)
_ISPAGE = f"(lower({_PATH}) NOT LIKE '%/wp-content/uploads/%' AND lower({_PATH}) NOT LIKE '%/wp-content/plugins/%' AND lower({_PATH}) NOT LIKE '%/wp-content/themes/%' AND regexp_extract({_NAME}, '[.]([^.]*)$', 1) NOT IN ({_ASSETS}) AND lower({_SCHEME}) IN ('http', 'https'))"
_SIGNALS = f"""array_to_string(list_filter([
  CASE WHEN list_has_any(list_transform(string_split({_QUERY}, '&'), lambda x: lower(split_part(x, '=', 1))), ['ajax', 'ajax_action', 'action', 'callback', 'handler', 'endpoint', 'wc-ajax']) THEN 'service_query' END,
  CASE WHEN regexp_matches({_NAME}, '{U.VERIFICATION}') THEN 'verification_file' END,
  CASE WHEN regexp_matches(lower({_PATH}), '{U.SERVICE_DIR}') THEN 'service_directory' END,
  CASE WHEN regexp_matches({_NAME}, '{U.SERVICE_NAME}') THEN 'service_name' END,
  CASE WHEN {_NAME} LIKE '%.php' AND (regexp_matches(lower({_PATH}), '{U.SERVICE_DIR}') OR regexp_matches({_NAME}, '{U.PHP_SERVICE}')) THEN 'service_php' END,
  CASE WHEN page_id % 9 = 0 THEN 'not_html' END, CASE WHEN page_id % 4 = 1 THEN 'not_a_page' END], lambda x: x IS NOT NULL), ',')"""
_T = X.sql(X.URLS)

PATTERNS = (("%", "*/news/*"), ("%", "?utm_source"), ("%", "wp-content"), ("%", "/blog/post-?/"))


def _one(name: str, make):
    def query(spark, sf_dir):
        return X.derive(spark, sf_dir, X.URLS, "pages").select("page_id", *make())

    query.__name__ = name
    return query


def _sql(columns: str) -> str:
    return f"SELECT page_id, {columns} FROM ({_T}) t"


_SINGLE = {
    "u01_normalize_url": (lambda: [U.normalize_url("url").alias("normalized")], "CASE WHEN regexp_matches(trim(url), '(?i)^https?://') THEN trim(url) WHEN trim(url) = '' THEN NULL ELSE 'https://' || trim(url) END AS normalized"),
    "u02_split_url": (lambda: [U.scheme("url").alias("scheme"), U.authority("url").alias("authority"), U.path("url").alias("path"), U.query("url").alias("query"), U.fragment("url").alias("fragment"), U.host("url").alias("host"), U.host("url", port=False).alias("bare_host")],
                      f"{_SCHEME} AS scheme, {_AUTH} AS authority, {_PATH} AS path, {_QUERY} AS query, regexp_extract(url, '^[^#]*#(.*)$', 1) AS fragment, {_HOST} AS host, split_part({_HOST}, ':', 1) AS bare_host"),
    "u03_page_key": (lambda: [U.page_key("url").alias("page_key")], f"{_LOWSCHEME} || '://' || {_HOST} || {_TRIMPATH} || CASE WHEN {_KEPT} = '' THEN '' ELSE '?' || {_KEPT} END AS page_key"),
    "u04_kept_query": (lambda: [U.kept_query("url").alias("kept")], f"{_KEPT} AS kept"),
    "u05_is_page": (lambda: [U.is_page("url").alias("is_page")], f"{_ISPAGE} AS is_page"),
    "u06_display_link": (lambda: [U.display_link("url").alias("link")], f"{_LOWSCHEME} || '://' || {_HOST} || {_CPATH} || CASE WHEN {_KEPT} = '' THEN '' ELSE '?' || {_KEPT} END AS link"),
    "u07_compare_url": (lambda: [U.compare_url("url").alias("compared")], f"{_LOWSCHEME} || '://' || CASE WHEN {_LOWSCHEME} = 'http' THEN regexp_replace(lower({_AUTH}), ':80$', '') ELSE regexp_replace(lower({_AUTH}), ':443$', '') END || {_TRIMPATH} AS compared"),
    "u09_section": (lambda: [U.section("url").alias("section")], f"CASE WHEN contains({_BARE}, '/') THEN '/' || split_part({_BARE}, '/', 1) || '/' ELSE '/' END AS section"),
    "u11_template_scope": (lambda: [U.template_scope("url").alias("scope")], f"""CASE WHEN len({_SEGMENTS}) = 0 THEN '/' WHEN lower({_SEGMENTS}[1]) IN ('catalog', 'katalog') AND len({_SEGMENTS}) >= 2 THEN '/' || {_SEGMENTS}[1] || '/' || {_SEGMENTS}[2] || '/'
      WHEN coalesce(list_position(list_transform({_SEGMENTS}, lambda x: lower(x)), 'blog'), 0) > 0 THEN '/' || array_to_string({_SEGMENTS}[1:list_position(list_transform({_SEGMENTS}, lambda x: lower(x)), 'blog')], '/') || '/' ELSE '/' || {_SEGMENTS}[1] || '/' END AS scope"""),
    "u12_slug_words": (lambda: [U.slug_words("url").alias("slug")], f"regexp_replace(list_extract(string_split({_BARE}, '/'), -1), '[-_]+', ' ', 'g') AS slug"),
    "u13_valid_url": (lambda: [U.looks_like_url("url").alias("valid")], r"(NOT regexp_matches(trim(url), '\s') AND regexp_matches(trim(url), '(?i)^https?://[^/?#]+')) AS valid"),
    "u15_list_filter": (lambda: [U.matches_lists("url", ["example", "/"], ["blog", "uploads"]).alias("listed")], "(contains(lower(url), 'example') AND contains(lower(url), '/') AND NOT contains(lower(url), 'blog') AND NOT contains(lower(url), 'uploads')) AS listed"),
    "u18_extension": (lambda: [U.extension("url").alias("extension")], f"lower(regexp_extract({_NAME}, '[.]([^.]+)$', 1)) AS extension"),
}


def u08_exclusions(spark, sf_dir):
    urls = X.derive(spark, sf_dir, X.URLS, "pages")
    rules = spark.createDataFrame([(None, p) for _, p in PATTERNS], "site string, pattern string")
    return U.drop_excluded(urls, rules).select("page_id", "url")


def u10_sections(spark, sf_dir):
    return U.group_by_section(X.derive(spark, sf_dir, X.URLS, "pages").select("site", "url"))


def u14_import_classes(spark, sf_dir):
    rows = X.derive(spark, sf_dir, X.URLS, "pages").select(F.col("url").alias("raw_value"), F.col("page_id").alias("pos"))
    return U.classify_imports(rows, F.lit("example.com")).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def u16_technical_signals(spark, sf_dir):
    from sitescope.functions import html as H

    parsed = H.parse(X.derive(spark, sf_dir, X.FETCHED, "pages"))
    return parsed.select("page_id", F.array_join(U.technical_signals("url", "content_type", "ordinary"), ",").alias("signals"))


def u17_resolved_links(spark, sf_dir):
    from sitescope.functions import html as H

    pages = X.table(spark, sf_dir, "pages")
    links = H.parse(pages).select("page_id", F.posexplode("links").alias("pos", "link"))
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("link.target").alias("target"))


def u19_pasted_urls(spark, sf_dir):
    urls = X.derive(spark, sf_dir, X.URLS, "pages")
    text = F.concat(F.trim("url"), F.lit("\n"), F.trim("url"), F.lit(", x ;https://a.example/"), F.col("page_id").cast("string"))
    return urls.select("page_id", F.explode(U.pasted_urls(text)).alias("pasted"))


QUERIES = {k: _one(k, make) for k, (make, _) in _SINGLE.items()} | {
    "u08_exclusions": u08_exclusions, "u10_sections": u10_sections, "u14_import_classes": u14_import_classes, "u16_technical_signals": u16_technical_signals, "u17_resolved_links": u17_resolved_links, "u19_pasted_urls": u19_pasted_urls,
}
_TARGET = f"lower({_PATH} || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END)"
_KEY = f"lower({_SCHEME}) || '://' || lower({_AUTH}) || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END"
ORACLE_SQL = {k: _sql(s) for k, (_, s) in _SINGLE.items()} | {
    "u08_exclusions": f"""SELECT page_id, url FROM ({_T}) t WHERE NOT ({_TARGET} GLOB '*/news/*' OR lower(url) GLOB '*/news/*' OR contains(lower({_QUERY}), 'utm_source')
      OR contains({_TARGET}, 'wp-content') OR contains(lower(url), 'wp-content') OR {_TARGET} GLOB '/blog/post-?/' OR lower(url) GLOB '/blog/post-?/')""",
    "u10_sections": f"""SELECT site, section, n_urls, row_number() OVER (PARTITION BY site ORDER BY n_urls DESC, section) AS rank FROM (
      SELECT site, CASE WHEN contains({_BARE}, '/') THEN '/' || split_part({_BARE}, '/', 1) || '/' ELSE '/' END AS section, count(*) AS n_urls FROM ({_T}) t GROUP BY 1, 2) g""",
    "u14_import_classes": rf"""WITH a AS (SELECT page_id AS pos, trim(url) AS url FROM ({_T}) t), b AS (
      SELECT pos, {_KEY} AS key, CASE WHEN regexp_matches(url, '\s') OR NOT regexp_matches(url, '(?i)^https?://[^/?#]+') THEN 'invalid' WHEN split_part({_HOST}, ':', 1) <> 'example.com' THEN 'other_domain' END AS kind FROM a),
      c AS (SELECT pos, coalesce(kind, CASE WHEN pos = min(pos) FILTER (WHERE kind IS NULL) OVER (PARTITION BY key) THEN 'kept' ELSE 'duplicate' END) AS class FROM b)
      SELECT class, count(*) AS n, min(pos) AS first_pos FROM c GROUP BY 1""",
    "u16_technical_signals": f"SELECT page_id, {_SIGNALS} AS signals FROM ({X.sql(X.FETCHED)}) t",
    "u17_resolved_links": r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages)
      SELECT page_id, pos, regexp_extract(url, '^[a-z]+://[^/?#]*') || replace(href, '&amp;', '&') AS target FROM l""",
    "u19_pasted_urls": f"""SELECT page_id, pasted FROM (SELECT page_id, unnest(list_distinct(list_filter(regexp_split_to_array(trim(url) || chr(10) || trim(url) || ', x ;https://a.example/' || page_id, '[\\s,;]+'), lambda x: regexp_matches(x, '(?i)^https?://')))) AS pasted FROM ({_T}) t) z""",
}
