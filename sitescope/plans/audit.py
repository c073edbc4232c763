"""Queries of the site audit, page rules and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.operators import images as I
from sitescope.operators import siteaudit as A
from sitescope.plans import fixture as X


def pages(spark, sf_dir):
    return X.derive(spark, sf_dir, X.PAGES, "pages")


def audited(spark, sf_dir):
    return A.audit_pages(pages(spark, sf_dir))


def _codes(c="issues"):
    return F.array_join(F.transform(c, lambda i: F.concat(i["code"], F.lit(":"), i["severity"])), ",")


def p01_core_issues(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", _codes(A.core_issues()).alias("issues"))


def p02_core_score(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", A.core_score(A.core_issues()).cast("long").alias("score"))


def p03_content_score(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("cs", A.content_score())
    return p.select("page_id", F.col("cs").cast("long").alias("content_score"), _codes(A.content_issues(F.col("cs"))).alias("issues"))


def p04_failed_pages(spark, sf_dir):
    return audited(spark, sf_dir).where("failed").select("page_id", F.col("score").cast("long").alias("score"), _codes().alias("issues"))


def p05_page_checks(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.explode(A.page_checks()).alias("c")).select("page_id", "c.category", "c.name", "c.status")


def p06_category_scores(spark, sf_dir):
    return A.category_scores(p05_page_checks(spark, sf_dir))


def p07_robots_flags(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", A.robots_flags("robots").alias("f")).select("page_id", "f.*")


def p08_indexability(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("page_type", F.when(F.col("page_id") % 41 == 0, "technical").otherwise("unknown")).withColumn("redirected", F.col("status_code") == 301)
    return p.select("page_id", A.indexability().alias("indexable"))


def p09_filtered_report(spark, sf_dir):
    return A.filter_report(audited(spark, sf_dir), "critical", "missing_h1", "example").select("page_id", F.col("score").cast("long").alias("score"))


def p10_worst_pages(spark, sf_dir):
    return A.worst_pages(audited(spark, sf_dir), 3).select("site", "rank", "page_id")


def a01_duplicates(spark, sf_dir):
    return A.all_duplicates(pages(spark, sf_dir)).select("site", "url", "code", "n")


def a02_issue_counts(spark, sf_dir):
    return A.issue_counts(A.exploded(audited(spark, sf_dir)))


def a03_severity_totals(spark, sf_dir):
    return A.severity_totals(A.exploded(audited(spark, sf_dir)))


def a04_site_summary(spark, sf_dir):
    return A.site_summary(audited(spark, sf_dir))


def a05_top_codes(spark, sf_dir):
    return A.top_codes(a02_issue_counts(spark, sf_dir), 5)


def a06_portfolio_totals(spark, sf_dir):
    latest = X.derive(spark, sf_dir, X.AUDITS, "orders").groupBy("project_id").agg(F.max_by(F.struct("pages_total", "critical", "warnings"), "id").alias("l"))
    return latest.agg(F.count(F.lit(1)).alias("audited"), F.sum("l.pages_total").alias("pages"), F.sum("l.critical").alias("critical"), F.sum("l.warnings").alias("warnings"))


def a07_work_items(spark, sf_dir):
    return A.work_items(A.exploded(audited(spark, sf_dir)), 2)


def _images(spark, sf_dir):
    return X.derive(spark, sf_dir, X.IMAGES, "pages", "nation"), X.derive(spark, sf_dir, X.IMAGE_META, "pages")


def i01_page_duplicate_alt(spark, sf_dir):
    return I.page_duplicates(_images(spark, sf_dir)[0])


def i02_site_duplicate_alt(spark, sf_dir):
    return I.site_duplicates(_images(spark, sf_dir)[0])


def i03_unique_images(spark, sf_dir):
    return I.unique_images(*_images(spark, sf_dir)).select("site", "src", "status_code", "size_bytes")


def i04_image_problems(spark, sf_dir):
    return I.with_problems(*_images(spark, sf_dir)).select("page_id", "idx", F.array_join("problems", ",").alias("problems"))


def i05_page_images(spark, sf_dir):
    return I.page_summary(pages(spark, sf_dir), I.with_problems(*_images(spark, sf_dir)))


def i06_site_images(spark, sf_dir):
    return I.site_totals(I.with_problems(*_images(spark, sf_dir)))


def i07_page_alt_report(spark, sf_dir):
    return I.page_alt_report(*_images(spark, sf_dir))


def i08_file_names(spark, sf_dir):
    im = _images(spark, sf_dir)[0].withColumn("name", F.concat(F.lit("Жёлтая Щука "), F.col("alt")))
    return I.file_names(im).select("page_id", "idx", "file_name")


def i09_alt_drafts(spark, sf_dir):
    return I.alt_drafts(_images(spark, sf_dir)[0], pages(spark, sf_dir), 2)


_ALL = (p01_core_issues, p02_core_score, p03_content_score, p04_failed_pages, p05_page_checks, p06_category_scores, p07_robots_flags, p08_indexability, p09_filtered_report, p10_worst_pages, a01_duplicates, a02_issue_counts, a03_severity_totals, a04_site_summary, a05_top_codes, a06_portfolio_totals, a07_work_items, i01_page_duplicate_alt, i02_site_duplicate_alt, i03_unique_images, i04_image_problems, i05_page_images, i06_site_images, i07_page_alt_report, i08_file_names, i09_alt_drafts)
QUERIES = {f.__name__: f for f in _ALL}

_CORE = """list_filter([
  CASE WHEN status_code < 200 OR status_code >= 300 THEN 'http_status:critical' END, CASE WHEN length(title) = 0 THEN 'missing_title:critical' END,
  CASE WHEN length(title) > 0 AND (length(title) < 30 OR length(title) > 65) THEN 'title_length:warning' END, CASE WHEN length(description) = 0 THEN 'missing_description:warning' END,
  CASE WHEN length(description) > 0 AND (length(description) < 70 OR length(description) > 170) THEN 'description_length:recommendation' END, CASE WHEN h1_count = 0 THEN 'missing_h1:critical' END,
  CASE WHEN h1_count > 1 THEN 'multiple_h1:warning' END, CASE WHEN canonical = '' THEN 'missing_canonical:warning' END, CASE WHEN contains(robots, 'noindex') THEN 'noindex:critical' END,
  CASE WHEN word_count < 200 THEN 'thin_content:recommendation' END, CASE WHEN internal_links < 3 THEN 'few_internal_links:recommendation' END, CASE WHEN missing_alt > 0 THEN 'missing_alt:warning' END], lambda x: x IS NOT NULL)"""
_CS = """least(100, greatest(0, CASE WHEN h1_count = 1 THEN 15 ELSE 0 END + CASE WHEN word_count >= 500 THEN 22 WHEN word_count >= 300 THEN 18 WHEN word_count >= 150 THEN 10 ELSE 0 END
  + CASE WHEN h2_count >= 2 THEN 13 WHEN h2_count = 1 THEN 8 ELSE 0 END + CASE WHEN h3_count >= 1 THEN 4 ELSE 0 END + CASE WHEN paragraphs >= 4 THEN 8 WHEN paragraphs >= 2 THEN 4 ELSE 0 END
  + CASE WHEN images > 0 THEN 7 + CAST(round_even(8.0 * greatest(0, images - missing_alt) / greatest(1, images), 0) AS INT) ELSE 0 END + CASE WHEN internal_links >= 3 THEN 13 WHEN internal_links >= 1 THEN 7 ELSE 0 END
  + CASE WHEN has_cta THEN 7 ELSE 0 END + CASE WHEN has_faq THEN 3 ELSE 0 END))"""
_CONTENT = """list_filter([CASE WHEN cs < 60 THEN 'low_content_fullness:warning' END, CASE WHEN h1_count = 0 THEN 'content_missing_h1:warning' END,
  CASE WHEN word_count < 150 THEN 'content_thin:warning' WHEN word_count < 300 THEN 'content_thin:recommendation' END, CASE WHEN h2_count = 1 AND word_count >= 500 THEN 'weak_heading_structure:recommendation' END,
  CASE WHEN h2_count = 0 AND word_count >= 250 THEN 'weak_heading_structure:warning' END, CASE WHEN h3_count = 0 AND word_count >= 900 THEN 'weak_heading_structure:recommendation' END,
  CASE WHEN paragraphs < 2 AND word_count >= 200 THEN 'weak_paragraph_structure:recommendation' END, CASE WHEN images > 0 AND missing_alt > 0 THEN 'content_missing_alt:recommendation' END,
  CASE WHEN images = 0 AND word_count >= 300 THEN 'no_content_images:recommendation' END, CASE WHEN internal_links = 0 THEN 'content_few_links:warning' WHEN internal_links < 3 THEN 'content_few_links:recommendation' END,
  CASE WHEN NOT has_cta THEN 'missing_cta:recommendation' END, CASE WHEN NOT has_faq THEN 'missing_faq:recommendation' END], lambda x: x IS NOT NULL)"""
_P = X.sql(X.PAGES)
_SCORE = "greatest(0, 100 - list_sum(list_transform(list_concat(core, ['x']), lambda x: CASE WHEN x = 'x' THEN 0 WHEN x LIKE '%:critical' THEN 16 WHEN x LIKE '%:warning' THEN 7 ELSE 3 END)))"
_BASE = f"""WITH b AS (SELECT *, {_CORE} AS core, fetch_error <> '' OR NOT contains(content_type, 'html') AS failed FROM ({_P}) p),
  b2 AS (SELECT *, CASE WHEN failed THEN 0 ELSE {_CS} END AS cs FROM b), aud AS (SELECT *, CAST(CASE WHEN failed THEN 0 ELSE {_SCORE} END AS BIGINT) AS score,
  CASE WHEN failed THEN ['fetch_error:critical'] ELSE list_concat(core, {_CONTENT}) END AS issues FROM b2),
  iss AS (SELECT site, url, split_part(i, ':', 1) AS code, split_part(i, ':', 2) AS severity FROM (SELECT site, url, unnest(issues) AS i FROM aud) u) """
_CHECKS = f"""(SELECT page_id, unnest(['technical', 'technical', 'technical', 'metadata', 'metadata', 'content', 'content', 'links', 'images']) AS category, unnest(['status', 'canonical', 'robots', 'title', 'description', 'h1', 'words', 'internal', 'alt']) AS name,
  unnest([CASE WHEN status_code < 200 OR status_code >= 300 THEN 'error' ELSE 'good' END, CASE WHEN canonical = '' THEN 'warning' ELSE 'good' END, CASE WHEN contains(robots, 'noindex') THEN 'error' ELSE 'good' END,
  CASE WHEN length(title) = 0 THEN 'error' WHEN length(title) < 30 OR length(title) > 65 THEN 'warning' ELSE 'good' END, CASE WHEN length(description) = 0 THEN 'error' WHEN length(description) < 70 OR length(description) > 170 THEN 'warning' ELSE 'good' END,
  CASE WHEN h1_count = 0 THEN 'error' WHEN h1_count > 1 THEN 'warning' ELSE 'good' END, CASE WHEN word_count < 200 THEN 'warning' ELSE 'good' END, CASE WHEN internal_links < 3 THEN 'warning' ELSE 'good' END, CASE WHEN missing_alt > 0 THEN 'warning' ELSE 'good' END]) AS status FROM ({_P}) p)"""
_CL = lambda c: f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
_DUP = lambda f: f"SELECT site, url, 'duplicate_{f}' AS code, n FROM (SELECT site, url, count(*) OVER (PARTITION BY site, {_CL(f)}) AS n FROM ({_P}) p WHERE {_CL(f)} <> '') d WHERE n > 1"
_OK = "status_code >= 200 AND status_code < 300 AND NOT failed"
_I, _M = X.sql(X.IMAGES), X.sql(X.IMAGE_META)
_IMG = f"""WITH im AS (SELECT *, lower(alt) AS low FROM ({_I}) i), dup AS (SELECT site, low FROM im WHERE low <> '' GROUP BY 1, 2 HAVING count(DISTINCT src) > 1), m AS ({_M}),
  ch AS (SELECT im.*, m.size_bytes, m.status_code AS st, list_filter([CASE WHEN NOT has_alt THEN 'no_alt_attribute' END, CASE WHEN has_alt AND im.low = '' THEN 'empty_alt' END, CASE WHEN dup.low IS NOT NULL THEN 'duplicate_alt' END, CASE WHEN m.status_code >= 400 THEN 'http_error' END,
  CASE WHEN m.size_bytes > 1000000 THEN 'heavy' END, CASE WHEN NOT (src LIKE '%.webp') THEN 'old_format' END, CASE WHEN width IS NULL OR height IS NULL THEN 'no_dimensions' END], lambda x: x IS NOT NULL) AS problems
  FROM im LEFT JOIN m USING (src) LEFT JOIN dup ON im.site = dup.site AND im.low = dup.low) """
_HAS = lambda c: f"count(*) FILTER (WHERE list_contains(problems, '{c}')) AS {c}"
ORACLE_SQL = {
    "p01_core_issues": f"SELECT page_id, array_to_string({_CORE}, ',') AS issues FROM ({_P}) p",
    "p02_core_score": f"SELECT page_id, CAST({_SCORE} AS BIGINT) AS score FROM (SELECT page_id, {_CORE} AS core FROM ({_P}) p) q",
    "p03_content_score": f"SELECT page_id, CAST(cs AS BIGINT) AS content_score, array_to_string({_CONTENT}, ',') AS issues FROM (SELECT *, {_CS} AS cs FROM ({_P}) p) q",
    "p04_failed_pages": _BASE + "SELECT page_id, score, array_to_string(issues, ',') AS issues FROM aud WHERE failed",
    "p05_page_checks": f"SELECT * FROM {_CHECKS} c",
    "p06_category_scores": f"SELECT page_id, category, CAST(round_even(avg(CASE status WHEN 'good' THEN 1.0 WHEN 'warning' THEN 0.55 ELSE 0.0 END) * 100, 0) AS BIGINT) AS percent, count(*) FILTER (WHERE status <> 'good') AS n_issues FROM {_CHECKS} c GROUP BY 1, 2",
    "p07_robots_flags": f"SELECT page_id, robots = 'noindex, follow' AS noindex, false AS nofollow, robots = 'all' AS index, robots IN ('all', 'noindex, follow') AS follow FROM ({_P}) p",
    "p08_indexability": f"SELECT page_id, CASE WHEN page_id % 41 = 0 THEN 'no' WHEN status_code = 301 OR status_code >= 400 THEN 'no' WHEN contains(robots, 'noindex') THEN 'no' WHEN canonical = 'https://example.org/other' THEN 'no' ELSE 'yes' END AS indexable FROM ({_P}) p",
    "p09_filtered_report": _BASE + "SELECT page_id, score FROM aud WHERE list_contains(issues, 'missing_h1:critical') AND contains(lower(concat_ws(' ', url, title, h1)), 'example')",
    "p10_worst_pages": _BASE + "SELECT site, rank, page_id FROM (SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY score, len(list_filter(issues, lambda x: x LIKE '%:critical')) DESC, len(issues) DESC, url) AS rank FROM aud) r WHERE rank <= 3",
    "a01_duplicates": " UNION ALL ".join(_DUP(f) for f in ("title", "description", "h1")),
    "a02_issue_counts": _BASE + "SELECT site, code, count(*) AS n FROM iss GROUP BY 1, 2",
    "a03_severity_totals": _BASE + "SELECT site, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'recommendation') AS recommendation FROM iss GROUP BY 1",
    "a04_site_summary": _BASE + f"""SELECT site, count(*) AS pages, count(*) FILTER (WHERE {_OK}) AS success, CAST(round_even(avg(score), 0) AS BIGINT) AS score, CAST(coalesce(round_even(avg(cs) FILTER (WHERE {_OK}), 0), 0) AS BIGINT) AS content_score,
      count(*) FILTER (WHERE {_OK} AND cs < 60) AS low_content, count(*) FILTER (WHERE {_OK} AND NOT has_faq) AS no_faq, count(*) FILTER (WHERE {_OK} AND NOT has_cta) AS no_cta, count(*) >= 500 AS limited FROM aud GROUP BY 1""",
    "a05_top_codes": _BASE + "SELECT site, code, n, rank FROM (SELECT site, code, n, row_number() OVER (PARTITION BY site ORDER BY n DESC, code) AS rank FROM (SELECT site, code, count(*) AS n FROM iss GROUP BY 1, 2) c) r WHERE rank <= 5",
    "a06_portfolio_totals": f"SELECT count(*) AS audited, CAST(sum(pages_total) AS BIGINT) AS pages, CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(warnings) AS BIGINT) AS warnings FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY id DESC) AS r FROM ({X.sql(X.AUDITS)}) a) t WHERE r = 1",
    "a07_work_items": _BASE + "SELECT site, code, count(*) AS n, array_to_string((list_sort(list(url)))[1:2], '|') AS urls, greatest(0, count(*) - 2) AS more FROM iss WHERE severity = 'critical' GROUP BY 1, 2",
    "i01_page_duplicate_alt": f"SELECT page_url, lower(alt) AS alt, count(*) AS n FROM ({_I}) i WHERE alt <> '' GROUP BY 1, 2 HAVING count(*) > 1",
    "i02_site_duplicate_alt": f"SELECT site, lower(alt) AS alt, count(DISTINCT src) AS n FROM ({_I}) i WHERE alt <> '' GROUP BY 1, 2 HAVING count(DISTINCT src) > 1",
    "i03_unique_images": f"SELECT i.site, i.src, m.status_code, m.size_bytes FROM (SELECT DISTINCT site, src FROM ({_I}) x) i LEFT JOIN ({_M}) m ON i.src = m.src",
    "i04_image_problems": _IMG + "SELECT page_id, idx, array_to_string(problems, ',') AS problems FROM ch",
    "i05_page_images": _IMG + f"SELECT p.url AS page_url, count(ch.page_url) AS images, count(*) FILTER (WHERE len(problems) > 0) AS problem_images, {_HAS('empty_alt')}, {_HAS('duplicate_alt')} FROM pages p LEFT JOIN ch ON ch.page_url = p.url GROUP BY p.url",
    "i06_site_images": _IMG + f"""SELECT site, count(*) AS occurrences, {', '.join(_HAS(c) for c in ('no_alt_attribute', 'empty_alt', 'duplicate_alt', 'http_error', 'heavy', 'old_format', 'no_dimensions'))}, count(DISTINCT page_url) AS pages,
      count(DISTINCT page_url) FILTER (WHERE len(problems) > 0) AS pages_with_errors, count(DISTINCT src) AS unique_images FROM ch GROUP BY 1""",
    "i07_page_alt_report": _IMG + """, tw AS (SELECT page_url, array_to_string(list_sort(list(low)), '|') AS repeated FROM (SELECT page_url, low FROM im WHERE low <> '' GROUP BY 1, 2 HAVING count(*) > 1) d GROUP BY 1)
      SELECT ch.page_url, count(*) FILTER (WHERE low = '') AS missing_alt, count(*) FILTER (WHERE NOT has_alt) AS missing_attribute, count(*) FILTER (WHERE size_bytes > 1000000) AS heavy, coalesce(any_value(repeated), '') AS repeated FROM ch LEFT JOIN tw ON tw.page_url = ch.page_url GROUP BY 1""",
    "i08_file_names": f"SELECT page_id, idx, regexp_replace('zheltaya-schuka-' || replace(lower(alt), ' ', '-'), '-+$', '') || '-' || lpad(CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) AS VARCHAR), 2, '0') AS file_name FROM ({_I}) i",
    "i09_alt_drafts": f"""SELECT m.page_id, idx, CASE WHEN n = 1 THEN subject ELSE subject || ' — ' || n END AS draft FROM (SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS n FROM ({_I}) i WHERE alt = '') m
      JOIN (SELECT page_id, CASE WHEN h1 <> '' THEN h1 ELSE trim(regexp_split_to_array(title, '\\s+[|—–-]\\s+')[1]) END AS subject FROM ({_P}) p) s ON m.page_id = s.page_id WHERE n <= 2 AND subject <> ''""",
}
