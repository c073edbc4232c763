"""Queries over the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.functions import html as H
from sitescope.functions import urls as U
from sitescope.operators import links as L
from sitescope.plans import fixture as X
from sitescope.sources.tables import settled


def tables(spark, sf_dir, sites=str):
    """(pages, links, homes) of the derived graph, written once, as every query joins them several times. ``sites``: what
    becomes of the definitions' number of sites (``str``: nothing)."""
    pages = settled(X.derive(spark, sf_dir, sites(X.RANKED), "pages"))
    links = settled(X.derive(spark, sf_dir, sites(X.LINKS), "pages", "nation"))
    return pages, links, pages.where("rn = 1").select("site", "key")


def metrics(spark, sf_dir):
    return L.page_metrics(*tables(spark, sf_dir))


def statuses(spark, sf_dir):
    pages, links, _ = tables(spark, sf_dir)
    status = pages.select("site", F.col("key").alias("dst_key"), "status_code", F.when(F.col("status_code") == 301, "x").otherwise("").alias("redirect_to"))
    return L.link_status(L.edges(links), status)


def l01_outgoing_links(spark, sf_dir):
    parsed = H.parse(X.table(spark, sf_dir, "pages"))
    return L.outgoing(parsed).select("src_key", "dst_key", "anchor", "link_type", F.col("pos").cast("long").alias("pos"))


def l02_distinct_pages(spark, sf_dir):
    pages = X.derive(spark, sf_dir, X.PAGES, "pages").withColumn("key", F.regexp_replace("title", "[0-9]", ""))
    return L.distinct_pages(pages).select("site", "key", "page_id")


def l03_edges(spark, sf_dir):
    return L.edges(tables(spark, sf_dir)[1])


def l04_degrees(spark, sf_dir):
    pages, links, _ = tables(spark, sf_dir)
    return L.degrees(L.edges(links), pages)


def l05_click_depth(spark, sf_dir):
    pages, links, homes = tables(spark, sf_dir)
    return L.depths(L.edges(links), pages, homes)


def l06_flags(spark, sf_dir):
    return L.page_metrics(*tables(spark, sf_dir, X.seven))


def l07_link_status(spark, sf_dir):
    return statuses(spark, sf_dir).select("site", "src_key", "dst_key", F.col("status_code").cast("long").alias("status_code"), "kind")


def l08_donors(spark, sf_dir):
    pages, links, homes = tables(spark, sf_dir)
    return L.donors(links, L.depths(L.edges(links), pages, homes), 5)


def l09_self_links(spark, sf_dir):
    return L.self_links(tables(spark, sf_dir)[1])


def _topics(spark, sf_dir, sites=str):
    return L.page_topics(X.derive(spark, sf_dir, sites(X.RANKED), "pages"))


def l10_topic_tokens(spark, sf_dir):
    return _topics(spark, sf_dir).select("page_id", F.explode("tokens").alias("token"))


def l11_donor_suggestions(spark, sf_dir):
    pages, links, homes = tables(spark, sf_dir, X.seven)
    met = settled(L.page_metrics(pages, links, homes))
    about = _topics(spark, sf_dir, X.seven).join(met.select("site", "key", "outgoing"), ["site", "key"])
    found = L.suggest_donors(L.in_need(met), about, L.edges(links))
    return found.join(L.in_need(met).select("site", F.col("key").alias("target"), "need"), ["site", "target"])


def l12_anchor_ideas(spark, sf_dir):
    pages = X.derive(spark, sf_dir, X.PAGES, "pages")
    return pages.select("page_id", F.array_join(L.anchor_ideas(F.col("h1"), F.col("title"), U.slug_words("url")), "|").alias("anchors"))


def l13_hubs(spark, sf_dir):
    _, links, _ = tables(spark, sf_dir)
    m = metrics(spark, sf_dir)
    top, inner = L.hubs(m, L.edges(links), 5)
    return inner


def l14_linking_score(spark, sf_dir):
    return L.linking_score(metrics(spark, sf_dir), statuses(spark, sf_dir))


def l15_coverage(spark, sf_dir):
    pages, _, homes = tables(spark, sf_dir)
    sitemap = pages.select("site", "key").union(pages.where("rn % 9 = 0").select("site", F.concat("key", F.lit("x"))))
    return L.coverage(pages, sitemap, homes)


def l16_report(spark, sf_dir):
    return L.ordered_report(metrics(spark, sf_dir), "weak", "s1").select("site", "key", "incoming")


def l17_weakest(spark, sf_dir):
    return L.weakest(metrics(spark, sf_dir), 4).select("site", "rank", "key")


def l18_work_items(spark, sf_dir):
    return L.work_items(metrics(spark, sf_dir), statuses(spark, sf_dir), 3)


_ALL = (l01_outgoing_links, l02_distinct_pages, l03_edges, l04_degrees, l05_click_depth, l06_flags, l07_link_status, l08_donors, l09_self_links, l10_topic_tokens, l11_donor_suggestions, l12_anchor_ideas, l13_hubs, l14_linking_score, l15_coverage, l16_report, l17_weakest, l18_work_items)
QUERIES = {f.__name__: f for f in _ALL}

_R, _L = X.sql(X.RANKED), X.sql(X.LINKS)
_BASE = f"""WITH RECURSIVE pg AS ({_R}), ln AS ({_L}), ed AS (SELECT DISTINCT site, src_key, dst_key FROM ln WHERE src_key <> dst_key),
  inn AS (SELECT e.site, dst_key AS key, count(*) AS incoming FROM ed e JOIN pg ON pg.site = e.site AND pg.key = e.src_key GROUP BY 1, 2), ou AS (SELECT e.site, src_key AS key, count(*) AS outgoing FROM ed e JOIN pg ON pg.site = e.site AND pg.key = e.dst_key GROUP BY 1, 2),
  deg AS (SELECT pg.site, pg.key, pg.rn, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing FROM pg LEFT JOIN inn ON inn.key = pg.key LEFT JOIN ou ON ou.key = pg.key),
  bfs AS (SELECT site, key, 0 AS depth FROM pg WHERE rn = 1 UNION SELECT p.site, p.key, b.depth + 1 FROM bfs b JOIN ed ON ed.src_key = b.key JOIN pg p ON p.key = ed.dst_key WHERE b.depth < 20),
  dep AS (SELECT site, key, min(depth) AS depth FROM bfs GROUP BY 1, 2),
  met AS (SELECT deg.site, deg.key, incoming, outgoing, depth, rn > 1 AND incoming = 0 AS orphan, rn > 1 AND incoming = 1 AS weak, outgoing = 0 AS no_outgoing, rn > 1 AND depth IS NULL AS unreachable, coalesce(depth >= 4, false) AS deep FROM deg LEFT JOIN dep ON dep.key = deg.key),
  sta AS (SELECT ed.site, src_key, dst_key, CAST(coalesce(status_code, 0) AS BIGINT) AS status_code, CASE WHEN status_code IS NULL OR status_code >= 400 THEN 'broken' WHEN status_code >= 300 THEN 'redirect' ELSE 'ok' END AS kind FROM ed LEFT JOIN pg ON pg.key = ed.dst_key) """
_KEY = lambda u: f"regexp_extract({u}, '^([a-z]+)://', 1) || '://' || regexp_replace(lower(regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', '') || regexp_replace(regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
_PAGE_KEY = lambda u: f"({_KEY(u)} || coalesce('?' || nullif(regexp_extract({u}, '[?&](page=[0-9]+)', 1), ''), ''))"
_UN = lambda x: f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_P = X.sql(X.PAGES)
_TOK = """list_distinct(list_filter(regexp_extract_all(replace(lower(concat_ws(' ', title, h1, regexp_replace(list_extract(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/'), -1), '[-_]+', ' ', 'g'))), 'ё', 'е'), '[a-zа-я0-9]{3,}'),
  lambda w: w NOT IN (%s) AND NOT regexp_matches(w, '^[0-9]+$')))""" % ", ".join(f"'{w}'" for w in L.STOP)
_SLUG = "regexp_replace(list_extract(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/'), -1), '[-_]+', ' ', 'g')"
_CUT = lambda x: f"trim(regexp_split_to_array(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '\\s+[|—–-]\\s+')[1])"
ORACLE_SQL = {
    "l01_outgoing_links": f"""SELECT src_key, dst_key, anchor, 'menu' AS link_type, min(pos) AS pos FROM (SELECT {_PAGE_KEY('url')} AS src_key, {_KEY("regexp_extract(url, '^[a-z]+://[^/?#]*') || href")} AS dst_key, anchor[1:180] AS anchor, pos
      FROM pages JOIN (WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) - 1 AS pos FROM pages)
        SELECT page_id, pos, {_UN("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href, trim(regexp_replace({_UN("regexp_extract(a, '>([^<]*)<', 1)")}, '\\s+', ' ', 'g')) AS anchor FROM l) a USING (page_id)) q GROUP BY 1, 2, 3""",
    "l02_distinct_pages": f"SELECT site, key, min(page_id) AS page_id FROM (SELECT *, regexp_replace(title, '[0-9]', '', 'g') AS key FROM ({_P}) p WHERE contains(content_type, 'html')) q GROUP BY 1, 2",
    "l03_edges": _BASE + "SELECT * FROM ed",
    "l04_degrees": _BASE + "SELECT site, key, incoming, outgoing FROM deg",
    "l05_click_depth": _BASE + "SELECT site, key, depth FROM dep",
    "l06_flags": X.seven(_BASE) + "SELECT * FROM met",
    "l07_link_status": _BASE + "SELECT * FROM sta",
    "l08_donors": _BASE + """, an AS (SELECT site, dst_key, src_key, anchor, min(pos) AS pos FROM ln WHERE src_key <> dst_key GROUP BY 1, 2, 3, 4), ag AS (SELECT site, dst_key, src_key, string_agg(anchor, ' · ' ORDER BY pos, anchor) AS anchors FROM an GROUP BY 1, 2, 3),
      ty AS (SELECT site, dst_key, src_key, CASE WHEN min(link_type) = max(link_type) THEN min(link_type) ELSE 'mixed' END AS link_type FROM ln WHERE src_key <> dst_key GROUP BY 1, 2, 3)
      SELECT * FROM (SELECT ty.site, ty.dst_key, ty.src_key, row_number() OVER (PARTITION BY ty.site, ty.dst_key ORDER BY depth NULLS LAST, ty.src_key) AS rank, anchors, link_type, depth FROM ty JOIN ag USING (site, dst_key, src_key) LEFT JOIN dep ON dep.key = ty.src_key) z WHERE rank <= 5""",
    "l09_self_links": f"WITH ln AS ({_L}) SELECT site, src_key AS key, string_agg(DISTINCT anchor, '|') AS anchors, string_agg(DISTINCT link_type, ',') AS types FROM ln WHERE src_key = dst_key GROUP BY 1, 2",
    "l10_topic_tokens": f"SELECT page_id, unnest({_TOK}) AS token FROM ({_R}) r",
    "l11_donor_suggestions": X.seven(_BASE) + f""", ab AS (SELECT pg.site, pg.key, pg.status_code, deg.outgoing, {_TOK} AS tok, string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/') AS st FROM pg JOIN deg USING (site, key)),
      nd AS (SELECT site, key, CASE WHEN orphan THEN 0 ELSE 1 END AS need FROM met WHERE orphan OR weak),
      pr AS (SELECT t.site, t.key AS target, d.key AS donor, need, len(list_intersect(t.tok, d.tok)) AS overlap, list_sort(list_intersect(t.tok, d.tok))[1:4] AS shared, len(t.tok) + len(d.tok) AS sizes, d.outgoing AS o,
        len(list_filter(range(1, least(len(t.st), len(d.st)) + 1), lambda k: t.st[1:k] = d.st[1:k])) AS prefix
        FROM ab t JOIN nd ON nd.site = t.site AND nd.key = t.key JOIN ab d ON d.site = t.site AND d.key <> t.key AND d.status_code BETWEEN 200 AND 299),
      sc AS (SELECT *, overlap / greatest(1.0, sizes - overlap) * 100 + prefix * 8 + least(o, 20) * 0.15 AS score FROM pr WHERE (overlap > 0 OR prefix > 0) AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.src_key = donor AND ed.dst_key = target))
      SELECT site, target, donor, round(score, 1) AS score, overlap, CASE WHEN overlap > 0 THEN 'общие темы: ' || array_to_string(shared, ', ') ELSE 'близкая ветка структуры сайта' END AS reason, rank, need
      FROM (SELECT *, row_number() OVER (PARTITION BY site, target ORDER BY round(score, 9) DESC, donor) AS rank FROM sc) q WHERE rank <= 3""",
    "l12_anchor_ideas": f"""SELECT page_id, array_to_string(list_transform(list_filter([t1, CASE WHEN lower(t2) <> lower(t1) THEN t2 ELSE '' END, CASE WHEN lower(t3) NOT IN (lower(t1), lower(t2)) THEN t3 ELSE '' END], lambda x: x <> ''), lambda x: x[1:110]), '|') AS anchors
      FROM (SELECT page_id, {_CUT('h1')} AS t1, {_CUT('title')} AS t2, {_CUT(_SLUG)} AS t3 FROM ({_P}) p) q""",
    "l13_hubs": _BASE + ", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY incoming DESC, outgoing DESC, key) AS rank FROM met) t WHERE rank <= 5) SELECT ed.* FROM ed JOIN top a ON a.key = ed.src_key JOIN top b ON b.key = ed.dst_key",
    "l14_linking_score": _BASE + """, s1 AS (SELECT site, count(*) AS pages, count(*) FILTER (WHERE orphan) AS orphan, count(*) FILTER (WHERE weak) AS weak, count(*) FILTER (WHERE deep) AS deep, count(*) FILTER (WHERE no_outgoing) AS no_outgoing FROM met GROUP BY 1),
      s2 AS (SELECT site, count(*) FILTER (WHERE kind = 'broken') AS broken, count(*) FILTER (WHERE kind = 'redirect') AS redirects FROM sta GROUP BY 1)
      SELECT site, pages, orphan, weak, deep, no_outgoing, broken, redirects, greatest(0, least(100, CAST(round_even(100 - (8 * orphan + 2 * weak + 8 * broken + 2 * redirects + 2 * deep + 2 * no_outgoing) / (20.0 * pages) * 100, 0) AS BIGINT))) AS score FROM s1 JOIN s2 USING (site)""",
    "l15_coverage": f"""WITH pg AS ({_R}) SELECT site, fetched, errors, not_crawled, home_crawled, false AS limited, home_crawled AND errors <= greatest(2, round_even(fetched * 0.05, 0)) AS sufficient, CASE WHEN home_crawled AND errors <= greatest(2, round_even(fetched * 0.05, 0)) THEN 'complete' WHEN NOT home_crawled THEN 'home' ELSE 'errors' END AS reason
      FROM (SELECT site, count(*) AS fetched, count(*) FILTER (WHERE status_code >= 400) AS errors, count(*) FILTER (WHERE rn % 9 = 0) AS not_crawled, bool_or(rn = 1 AND status_code < 400) AS home_crawled FROM pg GROUP BY 1) t""",
    "l16_report": _BASE + "SELECT site, key, incoming FROM met WHERE weak AND contains(key, 's1')",
    "l17_weakest": _BASE + "SELECT site, rank, key FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY orphan DESC, incoming, depth DESC NULLS FIRST, key) AS rank FROM met) t WHERE rank <= 4",
    "l18_work_items": _BASE + """, ev AS (SELECT site, 'broken' AS kind, src_key || ' -> ' || dst_key AS item FROM sta WHERE kind = 'broken' UNION ALL SELECT site, 'orphan', key FROM met WHERE orphan UNION ALL SELECT site, 'weak', key FROM met WHERE weak UNION ALL SELECT site, 'deep', key FROM met WHERE deep)
      SELECT site, kind, count(*) AS n, array_to_string(list_sort(list(item))[1:3], '|') AS items, CASE WHEN kind IN ('orphan', 'broken') THEN 'P1' WHEN kind = 'weak' THEN 'P2' ELSE 'P3' END AS priority FROM ev GROUP BY 1, 2""",
}
