"""Queries over meta descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.operators import metadesc as M
from sitescope.operators import siteaudit as A
from sitescope.plans import fixture as X

#: The audit's rows: pages of seven sites with a type, the redirect flag, and the raw description.
ROWS = """
SELECT page_id, url, concat('s', CAST(page_id % 7 AS VARCHAR(20))) AS site, status_code, robots, x_robots, canonical, fetch_error, title, h1, description AS description_raw, replace(description, '&amp;', '&') AS description,
  CASE WHEN page_id % 41 = 0 THEN 'technical' WHEN page_id % 2 = 0 THEN 'product' ELSE 'unknown' END AS page_type, status_code = 301 AS redirected FROM (PAGES) p
""".replace("PAGES", X.PAGES)


def rows(spark, sf_dir):
    return X.derive(spark, sf_dir, ROWS, "pages")


def audited(spark, sf_dir):
    return M.audit(rows(spark, sf_dir))


def m01_base_issues(spark, sf_dir):
    return rows(spark, sf_dir).select("page_id", F.array_join(M.base_issues(), ",").alias("issues"), F.array_join(M.entity_tokens("description_raw"), ",").alias("entities"))


def m02_duplicates(spark, sf_dir):
    return M.duplicate_counts(rows(spark, sf_dir), 3)


def m03_signatures(spark, sf_dir):
    return rows(spark, sf_dir).select("page_id", M.signature("description").alias("signature"))


def m04_template_groups(spark, sf_dir):
    return M.template_groups(rows(spark, sf_dir))


def m05_entity_groups(spark, sf_dir):
    return M.entity_groups(rows(spark, sf_dir).withColumn("issues", M.base_issues()))


def m06_statuses(spark, sf_dir):
    return audited(spark, sf_dir).select("page_id", "status")


def m07_summary(spark, sf_dir):
    return M.summary(audited(spark, sf_dir))


def m08_contacts(spark, sf_dir):
    return rows(spark, sf_dir).select("page_id", M.strip_contacts("description").alias("stripped"), M.safe_value("description").alias("safe"))


def m09_suggestions(spark, sf_dir):
    r = rows(spark, sf_dir).withColumn("indexable", A.indexability()).withColumn("facts", F.array(F.struct(F.lit("Weight").alias("label"), F.col("page_id").cast("string").alias("value"))))
    return M.suggest(r.withColumn("body", F.col("description"))).select("page_id", "proposal.description", F.array_join("proposal.used", ",").alias("used"), F.array_join("proposal.notes", ",").alias("notes"))


def m10_decisions(spark, sf_dir):
    events = X.table(spark, sf_dir, "events").select((F.col("event_id") % 400).alias("page_id"), F.col("event_id").alias("id"), F.col("ts").alias("decided_at"), F.when(F.col("event_id") % 3 == 0, "rejected").otherwise("accepted").alias("decision"))
    return M.apply_decisions(rows(spark, sf_dir).select("page_id"), events)


def m11_filtered_report(spark, sf_dir):
    return M.filter_report(audited(spark, sf_dir), st="template", search="model").select("page_id", "site")


def m12_drafts(spark, sf_dir):
    return M.drafts(X.derive(spark, sf_dir, X.PAGES, "pages"), "Shop")


_ALL = (m01_base_issues, m02_duplicates, m03_signatures, m04_template_groups, m05_entity_groups, m06_statuses, m07_summary, m08_contacts, m09_suggestions, m10_decisions, m11_filtered_report, m12_drafts)
QUERIES = {f.__name__: f for f in _ALL}

_R = X.sql(ROWS)
_PHONE = r"(?:\+?7|8)[\s\-\(\)]*\d{3}[\s\-\(\)]*\d{3}[\s\-]*\d{2}[\s\-]*\d{2}"
_HTTP = "(status_code < 200 OR status_code >= 400)"
_ISS = rf"""list_filter([CASE WHEN {_HTTP} THEN 'http_error' WHEN fetch_error <> '' AND page_type <> 'technical' THEN 'fetch_error' END, CASE WHEN page_type = 'technical' THEN 'technical_url' END, CASE WHEN redirected THEN 'redirect' END,
  CASE WHEN contains(robots, 'noindex') THEN 'noindex' END, CASE WHEN contains(x_robots, 'noindex') THEN 'x_robots_noindex' END, CASE WHEN canonical = 'https://example.org/other' THEN 'canonical_other' END, CASE WHEN description = '' THEN 'missing' END,
  CASE WHEN length(description) > 160 THEN 'too_long' END, CASE WHEN description <> '' AND length(description) < 70 THEN 'too_short' END, CASE WHEN description <> '' AND contains(description_raw, '&amp;') THEN 'html_entities' END,
  CASE WHEN regexp_matches(description, '{_PHONE}') THEN 'service_text' END], lambda x: x IS NOT NULL)"""
_NORM = "lower(trim(regexp_replace(description, '\\s+', ' ', 'g')))"
_SIG = rf"regexp_replace(regexp_replace(regexp_replace({_NORM}, '(?i)\b[a-zа-я]*\d+[a-zа-я0-9-]*\b', 'MODEL', 'g'), '\b\d+(?:[.,]\d+)?\b', '#', 'g'), '[«»\"''()]', '', 'g')"
_SCOPE = "CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*/+([^/?#]*)', 1) = '' THEN '/' ELSE '/' || regexp_extract(url, '^[a-z]+://[^/?#]*/+([^/?#]*)', 1) || '/' END"
_BASE = f"""WITH b AS (SELECT *, {_ISS} AS bi, {_NORM} AS norm, {_SIG} AS signature, {_SCOPE} AS scope FROM ({_R}) r),
  w AS (SELECT *, CASE WHEN norm <> '' THEN count(*) OVER (PARTITION BY site, norm) ELSE 0 END AS nd, CASE WHEN norm <> '' AND page_type <> 'technical' THEN count(*) FILTER (WHERE norm <> '' AND page_type <> 'technical') OVER (PARTITION BY site, scope, page_type, signature) ELSE 0 END AS nt,
    CASE WHEN list_contains(bi, 'html_entities') AND page_type <> 'technical' THEN count(*) FILTER (WHERE list_contains(bi, 'html_entities')) OVER (PARTITION BY site, scope, page_type) ELSE 0 END AS ne FROM b),
  aud AS (SELECT *, list_concat(bi, list_filter([CASE WHEN nd > 1 THEN 'duplicate' END, CASE WHEN nt >= 3 THEN 'template' END, CASE WHEN ne >= 5 THEN 'technical_template' END], lambda x: x IS NOT NULL)) AS issues FROM w),
  st AS (SELECT *, CASE WHEN list_contains(issues, 'http_error') THEN 'broken' WHEN page_type = 'technical' OR list_has_any(issues, ['technical_url', 'noindex', 'x_robots_noindex', 'redirect', 'canonical_other', 'fetch_error']) THEN 'technical'
    WHEN list_has_any(issues, ['template', 'technical_template']) THEN 'template' WHEN list_has_any(issues, ['missing', 'too_long', 'html_entities', 'duplicate', 'html_fragment']) THEN 'replace'
    WHEN list_has_any(issues, ['too_short', 'emoji', 'service_text']) THEN 'review' ELSE 'ok' END AS status FROM aud) """
_P = X.sql(X.PAGES)
_SLUG = "regexp_replace(list_extract(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/'), -1), '[-_]+', ' ', 'g')"
_SUBJ = f"CASE WHEN h1 <> '' THEN h1 WHEN title <> '' THEN title ELSE {_SLUG} END"
_COUNT = lambda s: f"count(*) FILTER (WHERE status = '{s}') AS {s}"
ORACLE_SQL = {
    "m01_base_issues": f"SELECT page_id, array_to_string({_ISS}, ',') AS issues, CASE WHEN contains(description_raw, '&amp;') THEN '&amp;' ELSE '' END AS entities FROM ({_R}) r",
    "m02_duplicates": _BASE + ", d AS (SELECT site, url, norm, nd AS n FROM w WHERE nd > 1) SELECT a.site, a.url, a.n, array_to_string(list_sort(list(b.url))[1:3], '|') AS others FROM d a JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, norm ORDER BY url) AS r FROM d) z WHERE r <= 4) b ON a.site = b.site AND a.norm = b.norm AND a.url <> b.url GROUP BY 1, 2, 3",
    "m03_signatures": f"SELECT page_id, {_SIG} AS signature FROM ({_R}) r",
    "m04_template_groups": _BASE + "SELECT site, scope, page_type, signature, count(*) AS n FROM b WHERE norm <> '' AND page_type <> 'technical' GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3",
    "m05_entity_groups": _BASE + "SELECT site, scope, page_type, count(*) AS n FROM b WHERE list_contains(bi, 'html_entities') AND page_type <> 'technical' GROUP BY 1, 2, 3 HAVING count(*) >= 5",
    "m06_statuses": _BASE + "SELECT page_id, status FROM st",
    "m07_summary": _BASE + f"SELECT site, count(*) AS pages, {', '.join(map(_COUNT, ('ok', 'review', 'replace', 'template', 'technical', 'broken')))}, count(*) FILTER (WHERE list_contains(issues, 'fetch_error')) AS fetch_errors, count(*) FILTER (WHERE status_code = 404) AS http_404, count(*) FILTER (WHERE status_code >= 500) AS http_5xx, count(*) FILTER (WHERE list_contains(issues, 'template')) AS in_templates FROM st GROUP BY 1",
    "m08_contacts": f"SELECT page_id, s AS stripped, regexp_replace(s, '^[ .;,:—–-]+|[ .;,:—–-]+$', '', 'g') AS safe FROM (SELECT page_id, trim(regexp_replace(regexp_replace(description, '{_PHONE}', '', 'g'), '\\s+', ' ', 'g')) AS s FROM ({_R}) r) q",
    "m10_decisions": f"SELECT r.page_id, coalesce(d.decision, 'pending') AS decision FROM ({_R}) r LEFT JOIN (SELECT event_id % 400 AS page_id, arg_max(CASE WHEN event_id % 3 = 0 THEN 'rejected' ELSE 'accepted' END, (ts, event_id)) AS decision FROM events GROUP BY 1) d ON d.page_id = r.page_id",
    "m11_filtered_report": _BASE + "SELECT page_id, site FROM st WHERE status = 'template' AND contains(lower(concat_ws(' ', url, title, description)), 'model')",
    "m12_drafts": f"""SELECT page_id, CASE WHEN length(s) < 45 AND length(s || ' | Shop') <= 65 THEN s || ' | Shop' ELSE s[1:65] END AS draft_title, CASE WHEN length(s || '. ' || description) <= 160 THEN s || '. ' || description ELSE regexp_replace((s || '. ' || description)[1:160], '\\s+\\S*$', '') END AS draft_description,
      array_to_string(list_filter([s, CASE WHEN title <> s THEN title ELSE '' END, CASE WHEN sl NOT IN (s, title) THEN sl ELSE '' END], lambda x: x <> ''), '|') AS anchors FROM (SELECT *, {_SUBJ} AS s, {_SLUG} AS sl FROM ({_P}) p) q""",
}
