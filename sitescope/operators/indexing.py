"""Indexing check: imported URLs joined with pages, link graph and sitemap, then classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitescope.operators.siteaudit import robots_flags

#: Fixed values.
REDIRECTS = (301, 302, 303, 307, 308)
LINK_CODES = ("orphan", "weak_inlinks", "missing_hub_link")


def enrich(imported: DataFrame, pages: DataFrame, metrics: DataFrame, sitemap: DataFrame, edges: DataFrame, homes: DataFrame) -> DataFrame:
    """One row an imported URL (site, url, key) with page features by exact URL, graph metrics by key, sitemap presence by
    key or final key, and whether the home page links to it; defaults where nothing is known."""
    smap = sitemap.groupBy("site", "key").agg(F.max_by(F.struct("priority", "changefreq"), "pos").alias("s"))
    same = [c for c in ("site", "key", "url") if c in pages.columns]  # pages of one address may have keys of their own
    own = imported.join(pages, same, "left").join(metrics, ["site", "key"], "left")
    own = own.withColumn("final_key", F.coalesce("final_key", "key"))
    by_key = smap.select("site", "key", F.col("s").alias("s1"))
    by_final = smap.select("site", F.col("key").alias("final_key"), F.col("s").alias("s2"))
    out = own.join(by_key, ["site", "key"], "left").join(by_final, ["site", "final_key"], "left")
    out = out.withColumn("sitemap", F.coalesce("s1", "s2")).drop("s1", "s2").withColumn("in_sitemap", F.col("sitemap").isNotNull())
    home = edges.join(homes.select("site", F.col("key").alias("src_key")), ["site", "src_key"], "left_semi").select("site", F.col("dst_key").alias("key"), F.lit(True).alias("home_link")).distinct()
    out = out.join(home, ["site", "key"], "left")
    return out.na.fill(False, ["home_link"]).na.fill(0, ["status_code", "initial_status_code", "incoming", "h1_count", "word_count"]).na.fill("", ["robots", "x_robots", "canonical", "content_type", "title", "h1"])


def hub_candidates(targets: DataFrame, donors: DataFrame, metrics: DataFrame, homes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(site, key, hub, kind): a donor that the page names a hub, else a shallow donor with many links, else the nearest
    existing ancestor, else none.

    ``donors``: (site, key, src_key, has_hub); ``ancestors``: (site, key, parent, distance) of existing pages.
    """
    about = metrics.select("site", F.col("key").alias("src_key"), F.col("depth").alias("d"), F.col("outgoing").alias("o"), F.col("incoming").alias("i"))
    real = donors.join(homes.select("site", F.col("key").alias("src_key")), ["site", "src_key"], "left_anti").join(about, ["site", "src_key"])
    pick = lambda df, order, kind, rank: df.withColumn("r", F.row_number().over(Window.partitionBy("site", "key").orderBy(*order))).where("r = 1").select("site", "key", F.struct(F.lit(rank).alias("rank"), F.col("src_key").alias("hub"), F.lit(kind).alias("kind")).alias("c"))
    typed = pick(real.where("has_hub"), [F.coalesce("d", F.lit(999)), F.desc("o"), F.col("src_key")], "structure", 1)
    broad = pick(real.where("d <= 2 and o >= 6"), [F.desc("o"), F.desc("i"), F.col("src_key")], "inferred", 2)
    above = pick(ancestors.withColumnRenamed("parent", "src_key"), [F.col("distance")], "ancestor", 3)
    best = typed.unionByName(broad).unionByName(above).groupBy("site", "key").agg(F.min("c").alias("c"))
    return targets.select("site", "key").distinct().join(best, ["site", "key"], "left").select("site", "key", F.col("c.hub").alias("hub"), F.coalesce("c.kind", F.lit("unknown")).alias("kind"))


def hub_status(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether the candidate links to the page: yes, no, or unknown without a candidate."""
    linked = edges.select("site", F.col("src_key").alias("hub"), F.col("dst_key").alias("key"), F.lit(True).alias("linked"))
    out = candidates.join(linked, ["site", "hub", "key"], "left")
    return out.withColumn("hub_status", F.when(F.col("hub").isNull(), "unknown").when(F.col("linked"), "yes").otherwise("no")).drop("linked")


def technical() -> Column:
    c, st = F.col, F.col("status_code")
    return F.array_compact(F.array(
        F.when(c("initial_status_code").isin(*REDIRECTS), "redirect"),
        F.when(st == 0, "unavailable").when(st == 404, "http_404").when(st >= 500, "http_5xx").when((st < 200) | (st >= 300), "http_status"),
        F.when((st != 0) & ~F.lower("content_type").contains("html"), "not_html"),
        F.when(robots_flags("robots")["noindex"], "meta_noindex"), F.when(robots_flags("x_robots")["noindex"], "x_robots_noindex"),
        F.when((c("canonical") != "") & (c("canonical_key") != c("final_key")), "canonical_other"), F.when(~c("in_sitemap"), "missing_sitemap"),
    ))


def content() -> Column:
    c = F.col
    enough, ok = c("sufficient"), (c("status_code") >= 200) & (c("status_code") < 300)
    return F.array_compact(F.array(
        F.when(enough & (c("incoming") == 0), "orphan").when(enough & (c("incoming") == 1) & ~c("home_link") & (c("hub_status") != "yes"), "weak_inlinks"),
        F.when(enough & c("hub").isNotNull() & (c("hub_status") == "no"), "missing_hub_link"),
        F.when(F.trim("title") == "", "missing_title"), F.when(F.trim("h1") == "", "missing_h1").when(c("h1_count") > 1, "multiple_h1"),
        F.when(ok & (c("word_count") == 0), "empty_content").when(ok & (c("word_count") < 50), "very_short_content"),
    ))


def notes() -> Column:
    c = F.col
    ok = (c("status_code") >= 200) & (c("status_code") < 300)
    return F.array_compact(F.array(
        F.when(c("canonical") == "", "no_canonical"), F.when(c("in_sitemap") & (F.coalesce(c("sitemap.priority"), F.lit("")) == ""), "no_priority"),
        F.when(c("in_sitemap") & (F.coalesce(c("sitemap.changefreq"), F.lit("")) == ""), "no_changefreq"), F.when(~c("sufficient"), "links_unknown"),
        F.when(ok & (c("word_count") >= 50) & (c("word_count") < 150), "short_text"),
    ))


def classify(rows: DataFrame) -> DataFrame:
    """Technical and content issues, notes, status and what to do. Any technical issue goes to the developer."""
    out = rows.withColumn("technical", technical()).withColumn("content", content()).withColumn("notes", notes())
    own = F.filter("content", lambda x: ~x.isin(*LINK_CODES))
    status = F.when(F.size("technical") > 0, "developer").when(F.size(own) > 0, "content").when(~F.col("sufficient"), "insufficient").when(F.size("content") > 0, "content").otherwise("ok")
    return out.withColumn("status", status)


def recommendations() -> Column:
    """Codes of advice, in the order in which it is given."""
    any_of = lambda col, *codes: F.arrays_overlap(col, F.array(*map(F.lit, codes)))
    tech = F.transform("technical", lambda x: F.when(x.startswith("http_") | x.isin("unavailable", "not_html"), "fix_availability").otherwise(F.concat(F.lit("check_"), x)))
    text = F.array_compact(F.array(
        F.when(any_of("content", "orphan"), "add_to_structure"), F.when(any_of("content", "orphan"), "add_context_links"), F.when(any_of("content", "weak_inlinks"), "strengthen_links"),
        F.when(any_of("content", "missing_hub_link"), "link_from_hub"), F.when(any_of("content", "missing_title", "missing_h1", "multiple_h1"), "fix_headings"), F.when(any_of("content", "empty_content", "very_short_content"), "review_text"),
    ))
    after = F.when(F.size("content") > 0, F.concat(tech, F.array(F.lit("then_content")))).otherwise(tech)
    return F.when(F.col("status") == "developer", after).when(F.col("status") == "content", text).when(F.col("status") == "insufficient", F.array(F.lit("crawl_again"))).otherwise(F.array(F.lit("nothing_found")))


def counts(classified: DataFrame) -> DataFrame:
    """(kind, code, n) of statuses and issues."""
    status = classified.groupBy(F.col("status").alias("code")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("status").alias("kind"), "code", "n")
    issues = classified.select(F.explode(F.concat("technical", "content")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).select(F.lit("issue").alias("kind"), "code", "n")
    return status.unionByName(issues)


def confirm_hubs(rows: DataFrame, overrides: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with confirmed hubs in place of inferred ones, ready to be classified again."""
    out = rows.drop("hub_status").join(overrides.select("site", "key", F.col("hub").alias("confirmed")), ["site", "key"], "left")
    out = out.withColumn("hub", F.coalesce("confirmed", "hub")).withColumn("kind", F.when(F.col("confirmed").isNotNull(), "confirmed").otherwise(F.col("kind"))).drop("confirmed")
    return hub_status(out, edges)


def report(classified: DataFrame, order: str = "status") -> DataFrame:
    rank = F.when(F.col("status") == "developer", 0).when(F.col("status") == "content", 1).when(F.col("status") == "insufficient", 2).otherwise(3)
    by = {"status": [rank, F.col("incoming"), F.col("url")], "url": [F.col("url")], "inlinks": [F.col("incoming"), F.col("url")], "depth": [F.coalesce("depth", F.lit(999)).desc(), F.col("url")]}
    return classified.orderBy(*by[order])
