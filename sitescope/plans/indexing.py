"""Queries of the indexing check."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.operators import indexing as N
from sitescope.operators import links as L
from sitescope.plans import fixture as X
from sitescope.plans import linking
from sitescope.sources.tables import settled

#: Features of the graph's pages.
FEATURES = """
SELECT r.url, r.site, r.key, r.page_id, r.rn, r.status_code, CASE WHEN r.page_id % 23 = 0 THEN 301 ELSE r.status_code END AS initial_status_code, 'text/html' AS content_type, CASE WHEN r.page_id % 13 = 0 THEN 'noindex' ELSE '' END AS robots,
  CASE WHEN r.page_id % 29 = 0 THEN 'none' ELSE '' END AS x_robots, CASE WHEN r.page_id % 7 = 3 THEN '' ELSE r.url END AS canonical, CASE WHEN r.page_id % 11 = 0 THEN 'other' ELSE r.key END AS canonical_key, r.key AS final_key,
  CASE WHEN r.page_id % 9 = 0 THEN '' ELSE r.title END AS title, r.h1, CAST(1 + (CASE WHEN r.page_id % 12 = 0 THEN 1 ELSE 0 END) AS INT) AS h1_count, CAST((r.page_id * 37) % 300 AS INT) AS word_count FROM (RANKED) r
""".replace("RANKED", X.RANKED)
SITEMAP = "SELECT site, key, CASE WHEN rn % 2 = 0 THEN '0.5' ELSE '' END AS priority, CASE WHEN rn % 3 = 0 THEN 'daily' ELSE '' END AS changefreq, rn AS pos FROM (RANKED) r WHERE rn % 8 <> 5".replace("RANKED", X.RANKED)


def _parts(s, d, sites):
    pages, links, homes = linking.tables(s, d, sites)
    metrics = settled(L.page_metrics(pages, links, homes))
    return pages, links, homes, metrics, L.edges(links)


def enriched(s, d, sites=str):
    pages, links, homes, metrics, edges = _parts(s, d, sites)
    features = X.derive(s, d, sites(FEATURES), "pages")
    sitemap = X.derive(s, d, sites(SITEMAP), "pages")
    rows = N.enrich(features.select("site", "key", "url"), features.drop("rn"), metrics.select("site", "key", "incoming", "outgoing", "depth"), sitemap, edges, homes)
    return rows, links, homes, metrics, edges


def candidates(s, d, sites=str):
    rows, links, homes, metrics, edges = enriched(s, d, sites)
    donors = links.where("src_key <> dst_key").groupBy("site", F.col("dst_key").alias("key"), "src_key").agg(F.max(F.col("link_type") == "hub").alias("has_hub"))
    parents = X.derive(s, d, sites(FEATURES), "pages").where("rn > 3").select("site", "key", F.concat("site", F.lit("#"), (F.col("rn") / 4).cast("long").cast("string")).alias("parent"), F.lit(1).alias("distance"))
    parents = parents.join(metrics.select("site", F.col("key").alias("parent")), ["site", "parent"], "left_semi")
    hubs = N.hub_status(N.hub_candidates(rows, donors, metrics, homes, parents), edges)
    return rows, hubs, edges


def full(s, d, sites=str):
    rows, hubs, edges = candidates(s, d, sites)
    return rows.join(hubs, ["site", "key"]).withColumn("sufficient", F.col("site") != "s3"), edges


def classified(s, d, sites=str):
    return N.classify(full(s, d, sites)[0])


def x01_joined(s, d):
    return enriched(s, d)[0].select("page_id", F.col("incoming").cast("long").alias("incoming"), "depth", F.col("status_code").cast("long").alias("status_code"))


def x02_sitemap_presence(s, d):
    return enriched(s, d)[0].select("page_id", "in_sitemap", F.coalesce("sitemap.priority", F.lit("")).alias("priority"))


def x03_home_link(s, d):
    return enriched(s, d)[0].select("page_id", "home_link")


def x04_hub_candidates(s, d):
    return candidates(s, d)[1].select("site", "key", "hub", "kind")


def x05_hub_status(s, d):
    return candidates(s, d)[1].select("site", "key", "hub_status")


def x06_classified(s, d):
    return classified(s, d).select("page_id", F.array_join("technical", ",").alias("technical"), F.array_join("content", ",").alias("content"), F.array_join("notes", ",").alias("notes"), "status")


def x07_recommendations(s, d):
    return classified(s, d, X.seven).select("page_id", F.array_join(N.recommendations(), ",").alias("advice"))


def x08_counts(s, d):
    return N.counts(classified(s, d))


def x09_confirmed_hubs(s, d):
    rows, edges = full(s, d)
    overrides = rows.where("page_id % 10 = 0").select("site", "key", F.concat("site", F.lit("#1")).alias("hub"))
    return N.classify(N.confirm_hubs(rows, overrides, edges)).select("page_id", "kind", "hub_status", "status")


def x10_report(s, d):
    return N.report(classified(s, d)).select("page_id", "status")


_ALL = (x01_joined, x02_sitemap_presence, x03_home_link, x04_hub_candidates, x05_hub_status, x06_classified, x07_recommendations, x08_counts, x09_confirmed_hubs, x10_report)
QUERIES = {f.__name__: f for f in _ALL}

_F, _SM = X.sql(FEATURES), X.sql(SITEMAP)
_OPT = lambda items: "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"
_TECH = _OPT(["CASE WHEN initial_status_code = 301 THEN 'redirect' END", "CASE WHEN status_code = 404 THEN 'http_404' WHEN status_code >= 500 THEN 'http_5xx' WHEN status_code >= 300 THEN 'http_status' END", "CASE WHEN robots = 'noindex' THEN 'meta_noindex' END",
              "CASE WHEN x_robots = 'none' THEN 'x_robots_noindex' END", "CASE WHEN canonical <> '' AND canonical_key <> key THEN 'canonical_other' END", "CASE WHEN NOT in_sitemap THEN 'missing_sitemap' END"])
_CONT = _OPT(["CASE WHEN sufficient AND incoming = 0 THEN 'orphan' WHEN sufficient AND incoming = 1 AND NOT home_link AND hub_status <> 'yes' THEN 'weak_inlinks' END", "CASE WHEN sufficient AND hub IS NOT NULL AND hub_status = 'no' THEN 'missing_hub_link' END",
              "CASE WHEN trim(title) = '' THEN 'missing_title' END", "CASE WHEN trim(h1) = '' THEN 'missing_h1' WHEN h1_count > 1 THEN 'multiple_h1' END", "CASE WHEN status_code < 300 AND word_count = 0 THEN 'empty_content' WHEN status_code < 300 AND word_count < 50 THEN 'very_short_content' END"])
_NOTE = _OPT(["CASE WHEN canonical = '' THEN 'no_canonical' END", "CASE WHEN in_sitemap AND priority = '' THEN 'no_priority' END", "CASE WHEN in_sitemap AND changefreq = '' THEN 'no_changefreq' END", "CASE WHEN NOT sufficient THEN 'links_unknown' END", "CASE WHEN status_code < 300 AND word_count >= 50 AND word_count < 150 THEN 'short_text' END"])
_STATUS = "CASE WHEN len(technical) > 0 THEN 'developer' WHEN len(list_filter(content, lambda x: x NOT IN ('orphan', 'weak_inlinks', 'missing_hub_link'))) > 0 THEN 'content' WHEN NOT sufficient THEN 'insufficient' WHEN len(content) > 0 THEN 'content' ELSE 'ok' END"


def _chain(hub: str, kind: str) -> str:
    return f""", f2 AS (SELECT *, {hub} AS hub, {kind} AS kind FROM joined), f3 AS (SELECT f2.*, CASE WHEN hub IS NULL THEN 'unknown' WHEN e.src_key IS NOT NULL THEN 'yes' ELSE 'no' END AS hub_status, f2.site <> 's3' AS sufficient FROM f2 LEFT JOIN ed e ON e.src_key = f2.hub AND e.dst_key = f2.key),
  f4 AS (SELECT *, {_TECH} AS technical, {_CONT} AS content, {_NOTE} AS notes FROM f3), cl AS (SELECT *, {_STATUS} AS status FROM f4) """


_BASE = linking._BASE + f""", ft AS ({_F}), sm AS ({_SM}), hub1 AS (SELECT dst_key AS key, src_key AS hub FROM (SELECT l.dst_key, l.src_key, row_number() OVER (PARTITION BY l.dst_key ORDER BY coalesce(m.depth, 999), m.outgoing DESC, l.src_key) AS r FROM (SELECT DISTINCT dst_key, src_key FROM ln WHERE src_key <> dst_key AND link_type = 'hub' AND src_key NOT LIKE '%#1') l JOIN met m ON m.key = l.src_key) z WHERE r = 1),
  hub2 AS (SELECT dst_key AS key, src_key AS hub FROM (SELECT e.dst_key, e.src_key, row_number() OVER (PARTITION BY e.dst_key ORDER BY m.outgoing DESC, m.incoming DESC, e.src_key) AS r FROM ed e JOIN met m ON m.key = e.src_key WHERE m.depth <= 2 AND m.outgoing >= 6 AND e.src_key NOT LIKE '%#1') z WHERE r = 1),
  joined AS (SELECT ft.*, met.incoming, met.depth, sm.key IS NOT NULL AS in_sitemap, sm.priority, sm.changefreq, h.dst_key IS NOT NULL AS home_link, hub1.hub AS h1x, hub2.hub AS h2x, CASE WHEN rn > 3 THEN ft.site || '#' || (rn // 4) END AS h3x FROM ft JOIN met ON met.key = ft.key LEFT JOIN sm ON sm.key = ft.key
    LEFT JOIN (SELECT DISTINCT dst_key FROM ed WHERE src_key LIKE '%#1') h ON h.dst_key = ft.key LEFT JOIN hub1 ON hub1.key = ft.key LEFT JOIN hub2 ON hub2.key = ft.key)"""
_HUB, _KIND = "coalesce(h1x, h2x, h3x)", "CASE WHEN h1x IS NOT NULL THEN 'structure' WHEN h2x IS NOT NULL THEN 'inferred' WHEN h3x IS NOT NULL THEN 'ancestor' ELSE 'unknown' END"
_CL = _BASE + _chain(_HUB, _KIND)
ORACLE_SQL = {
    "x01_joined": _BASE + " SELECT page_id, incoming, depth, CAST(status_code AS BIGINT) AS status_code FROM joined",
    "x02_sitemap_presence": _BASE + " SELECT page_id, in_sitemap, coalesce(priority, '') AS priority FROM joined",
    "x03_home_link": _BASE + " SELECT page_id, home_link FROM joined",
    "x04_hub_candidates": _CL + "SELECT site, key, hub, kind FROM cl",
    "x05_hub_status": _CL + "SELECT site, key, hub_status FROM cl",
    "x06_classified": _CL + "SELECT page_id, array_to_string(technical, ',') AS technical, array_to_string(content, ',') AS content, array_to_string(notes, ',') AS notes, status FROM cl",
    "x07_recommendations": X.seven(_CL) + """SELECT page_id, array_to_string(CASE status WHEN 'developer' THEN list_concat(list_transform(technical, lambda x: CASE WHEN x LIKE 'http_%' THEN 'fix_availability' ELSE 'check_' || x END), CASE WHEN len(content) > 0 THEN ['then_content'] ELSE [] END)
      WHEN 'content' THEN list_filter([CASE WHEN list_contains(content, 'orphan') THEN 'add_to_structure' END, CASE WHEN list_contains(content, 'orphan') THEN 'add_context_links' END, CASE WHEN list_contains(content, 'weak_inlinks') THEN 'strengthen_links' END, CASE WHEN list_contains(content, 'missing_hub_link') THEN 'link_from_hub' END,
        CASE WHEN list_has_any(content, ['missing_title', 'missing_h1', 'multiple_h1']) THEN 'fix_headings' END, CASE WHEN list_has_any(content, ['empty_content', 'very_short_content']) THEN 'review_text' END], lambda x: x IS NOT NULL)
      WHEN 'insufficient' THEN ['crawl_again'] ELSE ['nothing_found'] END, ',') AS advice FROM cl""",
    "x08_counts": _CL + "SELECT 'status' AS kind, status AS code, count(*) AS n FROM cl GROUP BY 2 UNION ALL SELECT 'issue', code, count(*) FROM (SELECT unnest(list_concat(technical, content)) AS code FROM cl) u GROUP BY 2",
    "x09_confirmed_hubs": _BASE + _chain(f"CASE WHEN page_id % 10 = 0 THEN site || '#1' ELSE {_HUB} END", f"CASE WHEN page_id % 10 = 0 THEN 'confirmed' ELSE {_KIND} END") + "SELECT page_id, kind, hub_status, status FROM cl",
    "x10_report": _CL + "SELECT page_id, status FROM cl",
}
