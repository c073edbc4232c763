"""Page rules, scores, cross-page checks and summaries of the site audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitescope.functions import html as H
from sitescope.functions import urls as U

#: Points that an issue of each severity costs.
PENALTY = {"critical": 16, "warning": 7, "recommendation": 3}


def issue(when: Column, code: str, severity: str | Column, label: Column | str = "") -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    text = F.lit(label or code.replace("_", " ")) if isinstance(label, str) else label
    return F.when(when, F.struct(F.lit(code).alias("code"), sev.alias("severity"), text.alias("label")))


def listed(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues))


def core_issues(p: str = "") -> Column:
    """The page-level signals that the page audit and the site audit share."""
    title, desc = F.length(f"{p}title"), F.length(f"{p}description")
    ok = (F.col("status_code") >= 200) & (F.col("status_code") < 300)
    return listed(
        issue(~ok, "http_status", "critical", F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))),
        issue(title == 0, "missing_title", "critical"),
        issue((title > 0) & ((title < 30) | (title > 65)), "title_length", "warning", F.concat(F.lit("Title: "), title.cast("string"))),
        issue(desc == 0, "missing_description", "warning"),
        issue((desc > 0) & ((desc < 70) | (desc > 170)), "description_length", "recommendation", F.concat(F.lit("Description: "), desc.cast("string"))),
        issue(F.col("h1_count") == 0, "missing_h1", "critical"),
        issue(F.col("h1_count") > 1, "multiple_h1", "warning"),
        issue(F.col("canonical") == "", "missing_canonical", "warning"),
        issue(F.lower("robots").contains("noindex"), "noindex", "critical"),
        issue(F.col("word_count") < 200, "thin_content", "recommendation"),
        issue(F.col("internal_links") < 3, "few_internal_links", "recommendation"),
        issue(F.col("missing_alt") > 0, "missing_alt", "warning"),
    )


def core_score(issues: Column) -> Column:
    cost = F.transform(issues, lambda i: F.when(i["severity"] == "critical", PENALTY["critical"]).when(i["severity"] == "warning", PENALTY["warning"]).otherwise(PENALTY["recommendation"]))
    return F.greatest(F.lit(0), 100 - F.aggregate(cost, F.lit(0), lambda a, x: a + x))


def content_score() -> Column:
    c = F.col
    alt_ok = F.greatest(F.lit(0), c("images") - c("missing_alt"))
    points = (
        F.when(c("h1_count") == 1, 15).otherwise(0)
        + F.when(c("word_count") >= 500, 22).when(c("word_count") >= 300, 18).when(c("word_count") >= 150, 10).otherwise(0)
        + F.when(c("h2_count") >= 2, 13).when(c("h2_count") == 1, 8).otherwise(0)
        + F.when(c("h3_count") >= 1, 4).otherwise(0)
        + F.when(c("paragraphs") >= 4, 8).when(c("paragraphs") >= 2, 4).otherwise(0)
        + F.when(c("images") > 0, 7 + F.bround(8 * alt_ok / F.greatest(F.lit(1), c("images"))).cast("int")).otherwise(0)
        + F.when(c("internal_links") >= 3, 13).when(c("internal_links") >= 1, 7).otherwise(0)
        + F.when(c("has_cta"), 7).otherwise(0)
        + F.when(c("has_faq"), 3).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), points))


def content_issues(score: Column) -> Column:
    """What keeps a page from being full; the low score itself goes first."""
    c = F.col
    words, rec, warn = c("word_count"), "recommendation", "warning"
    return listed(
        issue(score < 60, "low_content_fullness", warn),
        issue(c("h1_count") == 0, "content_missing_h1", warn),
        issue(words < 300, "content_thin", F.when(words >= 150, rec).otherwise(warn)),
        issue((c("h2_count") == 1) & (words >= 500), "weak_heading_structure", rec),
        issue((c("h2_count") == 0) & (words >= 250), "weak_heading_structure", warn),
        issue((c("h3_count") == 0) & (words >= 900), "weak_heading_structure", rec),
        issue((c("paragraphs") < 2) & (words >= 200), "weak_paragraph_structure", rec),
        issue((c("images") > 0) & (c("missing_alt") > 0), "content_missing_alt", rec),
        issue((c("images") == 0) & (words >= 300), "no_content_images", rec),
        issue(c("internal_links") < 3, "content_few_links", F.when(c("internal_links") >= 1, rec).otherwise(warn)),
        issue(~c("has_cta"), "missing_cta", rec),
        issue(~c("has_faq"), "missing_faq", rec),
    )


def is_failed() -> Column:
    return (F.col("fetch_error") != "") | ~F.lower("content_type").contains("html")


def audit_pages(pages: DataFrame) -> DataFrame:
    """Pages with core and content issues and both scores; a page that could not be fetched has one issue and no points."""
    low = content_score()
    full = pages.withColumn("failed", is_failed())
    fetch = listed(issue(F.lit(True), "fetch_error", "critical"))
    scored = full.withColumn("core", core_issues()).withColumn("content_score", F.when(F.col("failed"), 0).otherwise(low))
    scored = scored.withColumn("score", F.when(F.col("failed"), 0).otherwise(core_score(F.col("core"))))
    return scored.withColumn("issues", F.when(F.col("failed"), fetch).otherwise(F.concat("core", content_issues(F.col("content_score"))))).drop("core")


def audit_html(pages: DataFrame) -> DataFrame:
    """Fetched pages (a snapshot with html) with their features, issues and scores: one pass over the HTML."""
    parsed = H.parse(pages)
    own = U.host("url", port=False)
    inside = F.filter(F.array_distinct(F.transform("links", lambda x: x["target"])), lambda t: U.host(t, port=False) == own)
    features = parsed.withColumn("internal_links", F.size(inside)).withColumn("missing_alt", F.size(F.filter("images", lambda i: i["alt"] == "")))
    return audit_pages(features.withColumn("images", F.size("images")))


def duplicates(pages: DataFrame, field: str, code: str) -> DataFrame:
    """Pages whose cleaned lower-case text another page of the site has, too; (site, url, code, n). Empty texts don't count.

    Counts are taken by a hash of the text, combine before the shuffle, and only repeated ones join back.
    """
    keyed = pages.select("site", "url", F.lower(U.clean(field)).alias("text")).where("text <> ''").withColumn("key", F.sha2("text", 256))
    often = keyed.groupBy("site", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(often, ["site", "key"]).select("site", "url", F.lit(code).alias("code"), "n")


def all_duplicates(pages: DataFrame) -> DataFrame:
    found = [duplicates(pages, f, f"duplicate_{f}") for f in ("title", "description", "h1")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def exploded(audited: DataFrame) -> DataFrame:
    return audited.select("site", "url", F.explode("issues").alias("i")).select("site", "url", "i.code", "i.severity")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("site", "code").agg(F.count(F.lit(1)).alias("n"))


def severity_totals(issues: DataFrame) -> DataFrame:
    return issues.groupBy("site").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in PENALTY))


def site_summary(audited: DataFrame, max_pages: int = 500) -> DataFrame:
    ok = (F.col("status_code") >= 200) & (F.col("status_code") < 300) & ~F.col("failed")
    return audited.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(ok).alias("success"),
        F.bround(F.avg("score")).cast("long").alias("score"),
        F.coalesce(F.bround(F.avg(F.when(ok, F.col("content_score")))), F.lit(0)).cast("long").alias("content_score"),
        F.count_if(ok & (F.col("content_score") < 60)).alias("low_content"),
        F.count_if(ok & ~F.col("has_faq")).alias("no_faq"),
        F.count_if(ok & ~F.col("has_cta")).alias("no_cta"),
        (F.count(F.lit(1)) >= max_pages).alias("limited"),
    )


def top_codes(counts: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("site").orderBy(F.desc("n"), "code")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def work_items(issues: DataFrame, shown: int = 30) -> DataFrame:
    """Critical issues by code: how many, the first pages, and how many more. Pages are ranked before they are gathered."""
    critical = issues.where("severity = 'critical'")
    w = Window.partitionBy("site", "code").orderBy("url")
    ranked = critical.withColumn("rank", F.row_number().over(w))
    first = ranked.where(F.col("rank") <= shown).groupBy("site", "code").agg(F.array_join(F.array_distinct(F.array_sort(F.collect_list("url"))), "|").alias("urls"))
    count = critical.groupBy("site", "code").agg(F.count(F.lit(1)).alias("n"))
    return count.join(first, ["site", "code"]).withColumn("more", F.greatest(F.lit(0), F.col("n") - shown))


def filter_report(audited: DataFrame, level: str | None = None, code: str | None = None, search: str | None = None) -> DataFrame:
    out = audited
    if level == "critical":
        out = out.where(F.exists("issues", lambda i: i["severity"] == "critical"))
    elif level == "low_content":
        out = out.where("content_score < 60")
    if code:
        out = out.where(F.exists("issues", lambda i: i["code"] == code))
    if search:
        text = F.lower(F.concat_ws(" ", "url", "title", "h1"))
        out = out.where(text.contains(search.lower()))
    return out.orderBy("score", "content_score", "url")


def worst_pages(audited: DataFrame, n: int) -> DataFrame:
    critical = F.size(F.filter("issues", lambda i: i["severity"] == "critical"))
    w = Window.partitionBy("site").orderBy("score", F.desc(critical), F.desc(F.size("issues")), "url")
    return audited.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def page_checks() -> Column:
    """Detailed checks of one page: category, name and status good, warning or error."""
    c, check = F.col, lambda cat, name, st: F.struct(F.lit(cat).alias("category"), F.lit(name).alias("name"), st.alias("status"))
    bad = lambda cond, worst="error": F.when(cond, worst).otherwise("good")
    title, desc = F.length("title"), F.length("description")
    return F.array(
        check("technical", "status", bad((c("status_code") < 200) | (c("status_code") >= 300))),
        check("technical", "canonical", bad(c("canonical") == "", "warning")),
        check("technical", "robots", bad(F.lower("robots").contains("noindex"))),
        check("metadata", "title", F.when(title == 0, "error").when((title < 30) | (title > 65), "warning").otherwise("good")),
        check("metadata", "description", F.when(desc == 0, "error").when((desc < 70) | (desc > 170), "warning").otherwise("good")),
        check("content", "h1", F.when(c("h1_count") == 0, "error").when(c("h1_count") > 1, "warning").otherwise("good")),
        check("content", "words", bad(c("word_count") < 200, "warning")),
        check("links", "internal", bad(c("internal_links") < 3, "warning")),
        check("images", "alt", bad(c("missing_alt") > 0, "warning")),
    )


def category_scores(checked: DataFrame) -> DataFrame:
    points = F.when(F.col("status") == "good", 1.0).when(F.col("status") == "warning", 0.55).otherwise(0.0)
    return checked.groupBy("page_id", "category").agg(F.bround(F.avg(points) * 100).cast("long").alias("percent"), F.count_if(F.col("status") != "good").alias("n_issues"))


def robots_flags(value: str) -> Column:
    low = F.lower(F.coalesce(F.col(value), F.lit("")))
    has = lambda w: low.rlike(rf"(^|[,\s:]){w}($|[,\s])")
    noindex, nofollow = has("none") | has("noindex"), has("none") | has("nofollow")
    return F.struct(
        noindex.alias("noindex"), nofollow.alias("nofollow"), ((has("all") | has("index")) & ~noindex).alias("index"), ((has("all") | has("follow")) & ~nofollow).alias("follow")
    )


def indexability(page_type: str = "page_type") -> Column:
    """yes, no or unknown, by the first rule that fits."""
    c = F.col
    other = (c("canonical") != "") & (U.compare_url("canonical") != U.compare_url("url"))
    return (
        F.when(c(page_type) == "technical", "no")
        .when((c("fetch_error") != "") & (c("status_code") == 0), "unknown")
        .when(c("redirected"), "no")
        .when((c("status_code") < 200) | (c("status_code") >= 400), "no")
        .when(F.lower("robots").contains("noindex"), "no")
        .when(F.lower("x_robots").contains("noindex"), "no")
        .when(other, "no")
        .when(c("status_code") == 200, "yes")
        .otherwise("unknown")
    )
