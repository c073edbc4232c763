"""History tables of projects: latest states, priorities, work plans, search and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that hint at a role, in the order in which later roles win ties.
ROLE_HINTS = {
    "content": ("text", "article", "description", "heading", "content"),
    "developer": ("code", "server", "redirect", "deploy", "error"),
    "seo": ("index", "sitemap", "canonical", "robots", "keyword"),
}
INTENTS = (("plan", ("plan", "priority", "what next")), ("audit", ("audit", "check", "score")), ("help", ("help", "how")))


def latest(rows: DataFrame, key: str = "project_id", order: str = "id") -> DataFrame:
    """The last row of each project: one partial aggregation instead of a sorted window."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def last_n(rows: DataFrame, n: int, key: str = "project_id", order: str = "id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def overview(projects: DataFrame, audits: DataFrame) -> DataFrame:
    """Every project with its latest score and the change since the audit before."""
    two = last_n(audits, 2)
    side = two.groupBy("project_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("before"))
    return projects.select("project_id", "name").join(side, "project_id", "left").withColumn("change", F.col("score") - F.col("before"))


def split_issues(issues: Column) -> tuple[Column, Column]:
    """(SEO, content): content issues are those about text, headings, images and calls to action."""
    content = lambda i: i["code"].rlike("content|weak_|missing_cta|missing_faq|no_content|alt")
    return F.filter(issues, lambda i: ~content(i)), F.filter(issues, content)


def priority_pages(audit: DataFrame, link: DataFrame, index: DataFrame, n: int = 20) -> DataFrame:
    """Pages by the severity of all reports' findings. Inputs: (site, url, points, problem)."""
    every = audit.select("*", F.lit("audit").alias("source")).unionByName(link.select("*", F.lit("links").alias("source"))).unionByName(index.select("*", F.lit("indexing").alias("source")))
    merged = every.groupBy("site", "url").agg(F.sum("points").alias("points"), F.array_join(F.array_sort(F.collect_set("problem")), "|").alias("problems"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))
    level = F.when(F.col("points") >= 8, "P1").when(F.col("points") >= 4, "P2").otherwise("P3")
    w = Window.partitionBy("site").orderBy(F.desc("points"), "url")
    return merged.withColumn("level", level).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def attention(counts: DataFrame) -> DataFrame:
    """Groups of a project that need attention, with a level. Input: one row a project with a count for each group."""
    groups = [c for c in counts.columns if c != "project_id"]
    long = counts.unpivot("project_id", groups, "area", "n")
    return long.withColumn("level", F.when(F.col("n") == 0, "ok").when(F.col("n") < 5, "warning").otherwise("critical"))


def deadline(text: Column) -> Column:
    """A date in three formats, or a d.m.y inside a sentence; null otherwise."""
    t = F.trim(F.coalesce(text, F.lit("")))
    whole = F.coalesce(F.try_to_timestamp(t, F.lit("d.M.yyyy")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")), F.try_to_timestamp(t, F.lit("d/M/yyyy"))).cast("date")
    inside = F.regexp_replace(F.regexp_extract(t, r"(\d{1,2}[./-]\d{1,2}[./-]\d{4})", 1), "[/-]", ".")
    return F.coalesce(whole, F.try_to_timestamp(inside, F.lit("d.M.yyyy")).cast("date"))


PARSED = "role_groups array<struct<role:string,items:array<struct<id:int>>>>, qa_checklist array<string>"


def progress(parsed_json: Column, done_json: Column) -> Column:
    """Struct done, total, percent: of a task's items and checks, those that are ticked."""
    p = F.from_json(parsed_json, PARSED)
    items = F.transform(F.flatten(F.transform(p["role_groups"], lambda g: g["items"])), lambda i: F.concat(F.lit("task-"), i["id"].cast("string")))
    checks = F.transform(F.coalesce(p["qa_checklist"], F.array().cast("array<string>")), lambda _, k: F.concat(F.lit("qa-"), k.cast("string")))
    valid = F.array_distinct(F.concat(F.coalesce(items, F.array().cast("array<string>")), checks))
    done = F.size(F.array_intersect(valid, F.coalesce(F.from_json(done_json, "array<string>"), F.array().cast("array<string>"))))
    total = F.size(valid)
    return F.struct(done.alias("done"), total.alias("total"), F.when(total > 0, F.bround(100 * done / total)).otherwise(0).cast("int").alias("percent"))


def work_plan(projects: DataFrame, audits: DataFrame, links: DataFrame, tasks: DataFrame, today: str) -> DataFrame:
    """One list of what to do: audit findings, link findings and open tasks, with scores.

    A finding goes if a task was made from it (``source_name`` = ``seo:<project>``). ``tasks`` has done and total counts.
    """
    c = F.col
    made = tasks.where("status <> 'done'").select(F.col("source_name").alias("made")).distinct()
    a = latest(audits).withColumn("made", F.concat(F.lit("seo:"), c("project_id").cast("string"))).join(made, "made", "left_anti").where("critical > 0 or warnings > 0")
    seo = a.select("project_id", F.lit("seo").alias("kind"), F.when(c("critical") > 0, "critical").otherwise("warnings").alias("title"),
                   F.when(c("critical") > 0, 100 + F.least(c("critical"), F.lit(20))).otherwise(52 + F.least(c("warnings"), F.lit(15))).alias("score"),
                   F.lit(False).alias("overdue"), F.when(c("critical") > 0, c("critical") <= 2).otherwise(c("warnings") <= 3).alias("quick"))
    l = latest(links)
    bad = c("orphans") + c("broken")
    link = l.where("orphans + broken > 0 or weak > 0").select("project_id", F.lit("linking").alias("kind"), F.when(bad > 0, "orphans_broken").otherwise("weak").alias("title"),
                   F.when(bad > 0, 94 + F.least(bad, F.lit(15))).otherwise(46 + F.least((c("weak") / 5).cast("int"), F.lit(12))).alias("score"),
                   F.lit(False).alias("overdue"), F.when(bad > 0, bad <= 2).otherwise(c("weak") <= 3).alias("quick"))
    due = deadline(c("deadline"))
    days = F.datediff(due, F.lit(today).cast("date"))
    left = F.greatest(F.lit(0), c("total") - c("done"))
    base = F.when(c("priority") == "P1", 88).when(c("priority") == "P2", 68).when(c("priority") == "P3", 48).otherwise(42)
    soon = F.when(days < 0, 30).when(days <= 2, 20).when(days <= 7, 10).otherwise(0)
    task = tasks.where("status <> 'done'").select("project_id", F.lit("task").alias("kind"), "title", (base + soon + F.when((left > 0) & (left <= 2), 6).otherwise(0)).alias("score"),
                   F.coalesce(days < 0, F.lit(False)).alias("overdue"), ((left > 0) & (left <= 3)).alias("quick"))
    every = seo.unionByName(link).unionByName(task).join(projects.select("project_id", "name"), "project_id")
    return every.withColumn("score", c("score").cast("long")).withColumn("urgent", c("score") >= 85)


def new_tasks(generated: DataFrame, existing: DataFrame) -> DataFrame:
    """Generated tasks that are not there yet, by project and source."""
    return generated.join(existing.select("project_id", "source_name").distinct(), ["project_id", "source_name"], "left_anti")


def upsert_latest(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("project_id", "state_key")) -> DataFrame:
    """The latest state of each key; of equal times the greater id wins."""
    every = old.unionByName(new)
    return every.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in every.columns if c not in keys)), F.struct("created_at", "id")).alias("s")).select(*keys, "s.*")


def memory_slice(events: DataFrame, recent: int = 24, per_kind: int = 8, chars: int = 200) -> DataFrame:
    """The latest events of each project, a few of each kind, oldest first, texts cut."""
    newest = last_n(events, recent).drop("rank")
    w = Window.partitionBy("project_id", "kind").orderBy(F.desc("id"))
    kept = newest.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_kind)
    order = Window.partitionBy("project_id").orderBy("id")
    return kept.select("project_id", "id", "kind", F.substring("title", 1, chars).alias("title"), F.row_number().over(order).cast("long").alias("pos"))


def activity(log: DataFrame, tasks: DataFrame, audits: DataFrame, n: int) -> DataFrame:
    """The newest entries of the log, or of tasks and audits while the log is empty."""
    made = tasks.select(F.lit("task").alias("kind"), "id", F.col("updated_at").alias("at")).unionByName(audits.select(F.lit("audit").alias("kind"), "id", F.col("created_at").alias("at")))
    own = log.select("kind", "id", F.col("created_at").alias("at"))
    rows = made if own.isEmpty() else own
    return rows.orderBy(F.desc("at"), "kind", F.desc("id")).limit(n)


def health(audits: DataFrame, links: DataFrame, tasks: DataFrame) -> DataFrame:
    """Counts of what is critical and what may improve, in a fixed order of codes, and open task items."""
    a = latest(audits).select("project_id", F.expr("stack(2, 1, 'seo_critical', critical, 2, 'seo_warnings', warnings) as (pos, code, n)"))
    l = latest(links).select("project_id", F.expr("stack(3, 3, 'orphans', orphans, 4, 'broken', broken, 5, 'weak', weak) as (pos, code, n)"))
    t = tasks.where("status <> 'done'").groupBy("project_id").agg(F.sum(F.greatest(F.lit(0), F.col("total") - F.col("done"))).alias("n")).select("project_id", F.lit(6).alias("pos"), F.lit("open_items").alias("code"), "n")
    rows = a.unionByName(l).unionByName(t).where("n > 0")
    return rows.withColumn("level", F.when(F.col("code").isin("seo_critical", "orphans", "broken"), "critical").otherwise("improve"))


def route(text: str) -> tuple[Column, Column]:
    """(role, intent): the role with the most hints (ties: the later name; none: coordinator), the first intent that fits."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    score = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    best = F.greatest(*(F.struct(score(words).alias("n"), F.lit(role).alias("role")) for role, words in ROLE_HINTS.items()))
    role = F.when(best["n"] > 0, best["role"]).otherwise("coordinator")
    hits = [F.when(sum((low.contains(w).cast("int") for w in words), F.lit(0)) > 0, name) for name, words in INTENTS]
    return role, F.coalesce(*hits, F.lit("chat"))


def filter_tasks(tasks: DataFrame, status: str | None = None, text: str | None = None) -> DataFrame:
    out = tasks.where(F.col("status") == status) if status else tasks
    if text:
        out = out.where(F.lower("title").contains(text.lower()))
    rank = F.when(F.col("priority") == "P1", 0).when(F.col("priority") == "P2", 1).otherwise(2)
    return out.orderBy(rank, deadline(F.col("deadline")).asc_nulls_last(), F.desc("updated_at"), "id")
