"""The internal link graph of many sites at once: keys, edges, inlinks, click depth, donors and scores.

Pages are keyed by (site, key); every join and grouping starts with the site, so sites spread over the cluster and one
large site spreads by its keys. Menu and footer links make a few targets hot; counts are of distinct edges, which combine
before the shuffle, and lists are ranked and cut before they are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitescope.functions import html as H
from sitescope.functions import urls as U
from sitescope.sources.tables import bucketed, dropped, settled, settled_counting, small


def outgoing(parsed: DataFrame, patterns: DataFrame | None = None, url: str = "url") -> DataFrame:
    """(site, src_key, dst_key, target, anchor, link_type, pos): links within the site to pages, each once by target,
    anchor and type, the first kept."""
    rows = parsed.select(U.host(url, port=False).alias("site"), U.page_key(url).alias("src_key"), F.posexplode("links").alias("pos", "l"))
    rows = rows.select("site", "src_key", U.display_link(F.col("l.target")).alias("target"), F.substring("l.anchor", 1, 180).alias("anchor"), F.col("l.type").alias("link_type"), "pos")
    rows = rows.where((U.host("target", port=False) == F.col("site")) & U.is_page("target"))
    if patterns is not None:
        rows = U.drop_excluded(rows, patterns, "target")
    rows = rows.withColumn("dst_key", U.page_key("target"))
    return rows.groupBy("site", "src_key", "dst_key", "anchor", "link_type").agg(F.min("pos").alias("pos"), F.min_by("target", "pos").alias("target"))


def distinct_pages(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """One HTML page for each (site, key): the first."""
    html = pages.where(F.lower("content_type").contains("html"))
    first = html.groupBy("site", "key").agg(F.min(order).alias(order))
    return html.join(first, ["site", "key", order], "left_semi")


def edges(links: DataFrame) -> DataFrame:
    return links.where("src_key <> dst_key").select("site", "src_key", "dst_key").distinct()


def self_links(links: DataFrame, most: int = 10) -> DataFrame:
    """Pages that link to themselves, with the first anchors and all types."""
    own = links.where("src_key = dst_key")
    anchors = own.where("anchor <> ''").groupBy("site", "src_key", "anchor").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("site", "src_key").orderBy("pos", "anchor")
    listed = anchors.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy("site", "src_key").agg(F.array_sort(F.collect_list(F.struct("r", "anchor"))).alias("a"))
    types = own.groupBy("site", "src_key").agg(F.array_join(F.array_sort(F.collect_set("link_type")), ",").alias("types"))
    return types.join(listed, ["site", "src_key"], "left").select("site", F.col("src_key").alias("key"), F.array_join(F.transform("a", lambda x: x["anchor"]), "|").alias("anchors"), "types")


def degrees(edge: DataFrame, pages: DataFrame) -> DataFrame:
    """Inlinks (distinct donors among known pages) and outlinks (distinct known targets) of every page."""
    known = pages.select("site", "key")
    inn = edge.join(known.withColumnRenamed("key", "src_key"), ["site", "src_key"], "left_semi").groupBy("site", F.col("dst_key").alias("key")).agg(F.count(F.lit(1)).alias("incoming"))
    out = edge.join(known.withColumnRenamed("key", "dst_key"), ["site", "dst_key"], "left_semi").groupBy("site", F.col("src_key").alias("key")).agg(F.count(F.lit(1)).alias("outgoing"))
    return known.join(inn, ["site", "key"], "left").join(out, ["site", "key"], "left").na.fill(0, ["incoming", "outgoing"])


def _reached_by_one(inner: DataFrame, homes: DataFrame) -> DataFrame:
    """(site, key, root, offset): for pages with a single link to them, the page that a walk back along such links ends at,
    and its length. Pages that only a circle leads to are left out.

    Each round follows FOLLOWED links found so far one after the other, so a walk takes rounds in the logarithm of its length.
    """
    single = inner.groupBy("site", "dst_key").agg(F.count(F.lit(1)).alias("n"), F.min("src_key").alias("root")).where("n = 1")
    single = single.select("site", F.col("dst_key").alias("key"), "root", F.lit(1).cast("long").alias("offset")).join(homes.select("site", "key"), ["site", "key"], "left_anti")
    now, open_before = settled(single), None
    while True:
        step = now.select("site", F.col("key").alias("root"), F.col("root").alias("next"), F.col("offset").alias("more"))
        moved = now
        for _ in range(FOLLOWED):
            far = (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset")
            moved = moved.join(step, ["site", "root"], "left").select("site", "key", F.coalesce("next", "root").alias("root"), far, F.col("next").isNotNull().alias("open"))
        moved, left = settled_counting(moved, "open")
        old, now = now, moved.drop("open")
        dropped(old)
        if not left or left == open_before:
            return now if not left else now.join(moved.where("open"), ["site", "key"], "left_anti")
        open_before = left


#: Links that one round of a walk back follows: walks grow by this factor and one.
FOLLOWED = 9


def depths(edge: DataFrame, pages: DataFrame, homes: DataFrame) -> DataFrame:
    """(site, key, depth): clicks from the home page, for pages that can be reached; all sites at once.

    A page with a single link to it is one click below that link's page. So walks along such pages shrink to one weighted
    link, and only pages with several links to them are searched level by level: the shrunken links lie in a table bucketed
    by their source, so that a level shuffles nothing but the pages whose distance has just improved.
    """
    known = pages.select("site", "key").distinct()
    inner = edge.join(known.select("site", F.col("key").alias("dst_key")), ["site", "dst_key"], "left_semi").select("site", "src_key", "dst_key").where("src_key <> dst_key")
    inner = settled(inner.join(known.select("site", F.col("key").alias("src_key")), ["site", "src_key"], "left_semi").distinct())
    start = settled(homes.join(known, ["site", "key"], "left_semi").select("site", "key", F.lit(0).cast("long").alias("depth")).distinct())
    walks = _reached_by_one(inner, start)
    walk = walks.select("site", F.col("key").alias("src_key"), "root", "offset")
    several = inner.join(walks.select("site", F.col("key").alias("dst_key")), ["site", "dst_key"], "left_anti").join(walk, ["site", "src_key"], "left")
    several = several.select("site", F.coalesce("root", "src_key").alias("src_key"), "dst_key", (F.coalesce("offset", F.lit(0)) + 1).alias("clicks")).where("src_key <> dst_key")
    table = bucketed(several.groupBy("site", "src_key", "dst_key").agg(F.min("clicks").alias("clicks")), "site", "src_key")
    found = frontier = start
    while True:
        step = frontier.select("site", F.col("key").alias("src_key"), "depth").join(table, ["site", "src_key"])
        step = step.groupBy("site", F.col("dst_key").alias("key")).agg(F.min(F.col("depth") + F.col("clicks")).alias("depth"))
        before = found.select("site", "key", F.col("depth").alias("before"))
        better, n = settled_counting(step.join(before, ["site", "key"], "left").where("before is null or depth < before").select("site", "key", "depth"))
        if not n:
            break
        now = settled(found.unionByName(better).groupBy("site", "key").agg(F.min("depth").alias("depth")))
        for old in {id(x): x for x in (found, frontier)}.values():
            dropped(old)
        found, frontier = now, better
    for old in (inner, table, better, *([] if frontier is found else [frontier])):
        dropped(old)
    ends = found.select("site", F.col("key").alias("root"), F.col("depth").alias("above"))
    below = walks.join(ends, ["site", "root"]).select("site", "key", (F.col("above") + F.col("offset")).alias("depth"))
    return found.unionByName(below).select("site", "key", F.col("depth").cast("int").alias("depth"))


def page_metrics(pages: DataFrame, links: DataFrame, homes: DataFrame) -> DataFrame:
    edge = edges(links)
    base = degrees(edge, pages).join(depths(edge, pages, homes), ["site", "key"], "left")
    home = homes.select("site", "key", F.lit(True).alias("is_home"))
    base = base.join(home, ["site", "key"], "left").na.fill(False, ["is_home"])
    c = F.col
    return base.select(
        "site", "key", "incoming", "outgoing", "depth", (~c("is_home") & (c("incoming") == 0)).alias("orphan"), (~c("is_home") & (c("incoming") == 1)).alias("weak"), (c("outgoing") == 0).alias("no_outgoing"),
        (~c("is_home") & c("depth").isNull()).alias("unreachable"), F.coalesce(c("depth") >= 4, F.lit(False)).alias("deep"),
    )


def html_graph(pages: DataFrame, patterns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, links) of the link graph, from fetched pages with html: pages keyed and each once, links within sites."""
    parsed = H.parse(pages)
    keyed = distinct_pages(parsed.select(U.host("url", port=False).alias("site"), U.page_key("url").alias("key"), "page_id", "url", "status_code", "content_type", "title", "h1"))
    return keyed, outgoing(parsed, patterns)


def link_status(edge: DataFrame, status: DataFrame) -> DataFrame:
    """Each edge with its target's status (0 if unknown) and whether it is broken or redirects."""
    joined = edge.join(status, ["site", "dst_key"], "left").na.fill(0, ["status_code"])
    kind = F.when((F.col("status_code") == 0) | (F.col("status_code") >= 400), "broken").when((F.col("status_code") >= 300) & (F.col("redirect_to") != ""), "redirect").otherwise("ok")
    return joined.withColumn("kind", kind)


def donors(links: DataFrame, depth: DataFrame, most: int = 80) -> DataFrame:
    """One row a (target, donor): distinct anchors in order, one type or mixed, the shallowest donors first."""
    real = links.where("src_key <> dst_key")
    anchors = real.where("anchor <> ''").groupBy("site", "dst_key", "src_key", "anchor").agg(F.min("pos").alias("pos"))
    listed = anchors.groupBy("site", "dst_key", "src_key").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "anchor"))), 1, 10), lambda x: x["anchor"]), " · ").alias("anchors"))
    types = real.groupBy("site", "dst_key", "src_key").agg(F.min("link_type").alias("a"), F.max("link_type").alias("b"))
    rows = types.join(listed, ["site", "dst_key", "src_key"], "left").join(depth.withColumnRenamed("key", "src_key"), ["site", "src_key"], "left")
    w = Window.partitionBy("site", "dst_key").orderBy(F.asc_nulls_last("depth"), "src_key")
    rows = rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)
    return rows.select("site", "dst_key", "src_key", "rank", F.coalesce("anchors", F.lit("")).alias("anchors"), F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("link_type"), "depth")


STOP = tuple(sorted(H.STOPWORDS))


#: The reasons for a suggestion.
COMMON_TOPICS, SAME_BRANCH = "общие темы: ", "близкая ветка структуры сайта"


def topic_tokens(*texts: Column) -> Column:
    """Distinct words of three letters or more, without stop words and numbers."""
    low = F.replace(F.lower(F.concat_ws(" ", *texts)), F.lit("ё"), F.lit("е"))
    words = F.regexp_extract_all(low, F.lit("([a-zа-я0-9]{3,})"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP) & ~w.rlike("^[0-9]+$")))


def page_topics(pages: DataFrame) -> DataFrame:
    """Pages with the tokens of title, h1 and slug, and of the parsed keywords where the table has them; and with the path."""
    keywords = [F.array_join("keywords", " ")] if "keywords" in pages.columns else []
    return pages.withColumn("tokens", topic_tokens(F.col("title"), F.col("h1"), U.slug_words("url"), *keywords)).withColumn("path", U.path("url"))


def _steps() -> Column:
    return F.split(F.regexp_replace("path", "^/+|/+$", ""), "/")


def in_need(metrics: DataFrame) -> DataFrame:
    """Pages that should get links: orphans first, then weak ones; (site, key, incoming, need)."""
    return metrics.where("orphan or weak").select("site", "key", "incoming", F.when(F.col("orphan"), 0).otherwise(1).alias("need"))


#: A token that more donors of a site hold is frequent there: it pairs groups of pages, never pages.
FREQUENT = 200


def _score(overlap: Column, sizes: Column, prefix: Column, outgoing: Column) -> Column:
    """What a donor is worth, in the precision that ranks it; ``sizes``: of both token sets together."""
    similar = overlap / F.greatest(F.lit(1), sizes - overlap)
    return F.round(similar * 100 + prefix * 8 + F.least(outgoing, F.lit(20)) * 0.15, 9)


def _ways() -> Column:
    """The beginnings of a path as numbers, from the empty one on: two paths share as many as they share steps, and one."""
    beginnings = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.xxhash64(F.array_join(F.slice("steps", F.lit(1), k), "/")))
    return F.concat(F.array(F.lit(0).cast("long")), beginnings)


def _by_beginning(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.posexplode("ways").alias("depth", "way"))


def _path_lists(d: DataFrame, group: list[str], most: int) -> DataFrame:
    """(site, group..., depth, way, donor, outgoing, r): under each beginning of the path (depth 0: any path) the donors of
    each group with the most outgoing links, up to ``most`` places."""
    w = Window.partitionBy("site", *group, "depth", "way").orderBy(F.desc(F.least("outgoing", F.lit(20))), "donor")
    rows = _by_beginning(d).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return rows.select("site", *group, "depth", "way", "donor", "outgoing", "r")


def _beside(t: DataFrame, d: DataFrame, most: int) -> DataFrame:
    """(site, target, donor, score): donors under the beginnings of a target's path, by what path and links are worth.

    Targets are told apart by powers of two of the places that they need, so one with many links lengthens no other's lists.
    """
    widths = sorted(r[0] for r in t.select("width").distinct().collect())  # some twenty at most
    wide = F.filter(F.array(*map(F.lit, widths)).cast("array<int>"), lambda x: x >= F.col("r"))
    lists = _path_lists(d, [], most).where("depth > 0").withColumn("width", F.explode(wide))
    score = _score(F.lit(0), F.lit(1), F.col("depth"), F.col("outgoing"))
    return _by_beginning(t).select("site", "target", "depth", "way", "width").join(lists, ["site", "depth", "way", "width"]).select("site", "target", "donor", score.alias("score"))


def _by_rare_tokens(t: DataFrame, d: DataFrame, often: DataFrame) -> DataFrame:
    """(site, target, donor, score): of the donors that hold a rare token, the best for each target with it.

    A rare token's donors are one row, which scores them against each of its targets in place: only the places that the
    target needs leave it, no pairs.
    """
    rare = lambda rows: rows.withColumn("token", F.explode("tokens")).join(often, ["site", "token"], "left_anti")
    lists = rare(d).groupBy("site", "token").agg(F.collect_list(F.struct("donor", "marks", "ways", "size", "outgoing")).alias("donors"))
    met = rare(t).select("site", "token", "target", "marks", "ways", "size", "places").join(lists, ["site", "token"])
    both = lambda x, c: F.size(F.array_intersect(F.col(c), x[c]))
    score = lambda x: _score(both(x, "marks"), F.col("size") + x["size"], both(x, "ways") - 1, x["outgoing"])
    scored = F.transform(F.filter("donors", lambda x: x["donor"] != F.col("target")), lambda x: F.struct((-score(x)).alias("less"), x["donor"].alias("donor")))
    best = met.select("site", "target", F.explode(F.slice(F.array_sort(scored), F.lit(1), F.col("places"))).alias("b"))
    return best.select("site", "target", "b.donor", (-F.col("b.less")).alias("score"))


def _by_classes(t: DataFrame, d: DataFrame, most: int) -> DataFrame:
    """(site, target, donor, score): of the donors that share frequent tokens, the best for each target by these alone.

    All donors of a class (frequent tokens, number of tokens) share as many with all targets of another. So classes meet,
    beginning by beginning of the path, where links alone rank the donors of a class: there a class is dropped if enough
    donors stand before it and links could not lift it to them. What is left is one list for all targets of a class and beginning.
    """
    named = lambda rows: rows.where("hot is not null").withColumn("class", F.xxhash64("hot", "size"))
    spelled = lambda rows, *keep: rows.select("site", *keep, F.explode(F.split("hot", " ")).alias("token"))
    d, t = named(d), named(t)
    place = ["site", "depth", "way"]
    own = [*place, "mine", "n_mine", "width"]
    lists = settled(_path_lists(d, ["class", "size"], most))
    theirs = lists.groupBy(*place, "class", "size").agg(F.count(F.lit(1)).alias("n"))
    theirs = theirs.join(spelled(d.select("site", "class", "hot").distinct(), "class"), ["site", "class"])
    asked = _by_beginning(t).select(*place, "target", F.col("class").alias("mine"), F.col("size").alias("n_mine"), "width")
    mine = asked.select(*own).distinct().join(spelled(t.select("site", F.col("class").alias("mine"), "hot").distinct(), "mine"), ["site", "mine"])
    pairs = mine.join(theirs, [*place, "token"]).groupBy(*own, "class", "size", "n").agg(F.count(F.lit(1)).alias("overlap"))
    pairs = pairs.withColumn("worth", _score(F.col("overlap"), F.col("n_mine") + F.col("size"), F.col("depth"), F.lit(0)))
    w = Window.partitionBy(*own)
    before = w.orderBy(F.desc("worth"), "class").rowsBetween(Window.unboundedPreceding, 0)
    enough = F.max(F.when(F.col("upto") >= F.col("width"), F.col("worth"))).over(w)
    ranked = pairs.withColumn("upto", F.sum("n").over(before)).withColumn("enough", enough)
    kept = ranked.where(F.col("enough").isNull() | (F.col("worth") + 3.001 >= F.col("enough")))
    met = kept.join(lists, [*place, "class", "size"]).where("r <= width")
    met = met.withColumn("score", _score(F.col("overlap"), F.col("n_mine") + F.col("size"), F.col("depth"), F.col("outgoing")))
    best = met.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "donor"))).where("r <= width")
    return asked.join(best.select(*own, "donor", "score"), own).select("site", "target", "donor", "score")


def suggest_donors(targets: DataFrame, pages: DataFrame, edge: DataFrame, n: int = 3, frequent: int = FREQUENT) -> DataFrame:
    """The best pages to link from, for each target: (site, target, donor, score, overlap, reason, rank).

    ``targets``: (site, key); ``pages``: (site, key, path, tokens, outgoing, status_code). A top-k join in three parts, each of
    which ranks by what it knows of a donor: pages that share a rare token, pages that share frequent tokens, and pages that
    share a beginning of the path. None knows more than is true, and one knows all of it or else enough better donors; so the
    first by the most that any part knows are the best. Only these few places a target and part leave for the ranking, and whole
    token sets meet for the best alone. No site and no token pairs all its pages.
    """
    linked = edge.select("site", F.col("src_key").alias("donor"), F.col("dst_key").alias("target"))
    chosen = targets.select("site", "key").distinct()
    own_links = linked.groupBy("site", F.col("target").alias("key")).agg(F.count(F.lit(1)).alias("k"))
    # places that a list must reach down to: the best and donors that link already; width: the target itself too
    places = (n + F.coalesce("k", F.lit(0))).cast("int")
    width = F.pow(F.lit(2), F.ceil(F.log2(places + 1))).cast("int")
    wanted = chosen.join(own_links, ["site", "key"], "left").select("site", "key", places.alias("places"), width.alias("width"))
    base = pages.select("site", "key", _steps().alias("steps"), "tokens", F.size("tokens").alias("size"), "outgoing", "status_code")
    base = settled(base.withColumn("marks", F.transform("tokens", lambda x: F.xxhash64(x))).withColumn("ways", _ways()))
    donor = F.col("status_code").between(200, 299)
    words = base.select("site", "key", donor.alias("donor"), F.explode("tokens").alias("token"))
    often = small(settled(words.where("donor").groupBy("site", "token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > frequent).select("site", "token")))
    hot = words.join(often, ["site", "token"]).groupBy("site", "key").agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("hot"))
    plain, base = base, settled(base.join(hot, ["site", "key"], "left"))
    dropped(plain)
    t = settled(base.join(wanted, ["site", "key"]).withColumnRenamed("key", "target"))
    d = base.where(donor).withColumnRenamed("key", "donor")
    most = t.agg(F.max("width")).first()[0] or 0
    listed = _by_rare_tokens(t, d, often).union(_by_classes(t, d, most)).union(_beside(t, d, most)).where("target <> donor")
    listed = listed.groupBy("site", "target", "donor").agg(F.max("score").alias("known")).join(linked, ["site", "target", "donor"], "left_anti")
    w = Window.partitionBy("site", "target").orderBy(F.desc("known"), "donor")
    best = listed.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
    about = lambda c: base.select("site", F.col("key").alias(c), F.col("tokens").alias(f"t_{c}"), F.col("steps").alias(f"p_{c}"), F.col("outgoing").alias(f"o_{c}"))
    full = best.join(about("target"), ["site", "target"]).join(about("donor"), ["site", "donor"])
    same = F.transform(F.sequence(F.lit(1), F.least(F.size("p_target"), F.size("p_donor"))), lambda k: F.slice("p_target", F.lit(1), k) == F.slice("p_donor", F.lit(1), k))
    prefix = F.size(F.filter(same, lambda x: x))
    full = full.withColumn("overlap", F.size(F.array_intersect("t_target", "t_donor")).cast("long"))
    score = _score(F.col("overlap"), F.size("t_target") + F.size("t_donor"), prefix, F.col("o_donor"))
    shared = F.slice(F.array_sort(F.array_intersect("t_target", "t_donor")), 1, 4)
    reason = F.when(F.col("overlap") > 0, F.concat(F.lit(COMMON_TOPICS), F.array_join(shared, ", "))).otherwise(F.lit(SAME_BRANCH))
    return full.select("site", "target", "donor", F.round(score, 1).alias("score"), "overlap", reason.alias("reason"), "rank")


def anchor_ideas(h1: Column, title: Column, slug: Column) -> Column:
    """Up to three distinct anchors: texts cut at a separator and at 110 characters."""
    cut = lambda x: F.trim(F.element_at(F.split(U.clean(x), r"\s+[|—–-]\s+"), 1))
    texts = F.filter(F.array(cut(h1), cut(title), cut(slug)), lambda x: x != "")
    fresh = F.filter(F.transform(texts, lambda x, k: F.struct(x.alias("t"), (F.array_position(F.transform(texts, lambda y: F.lower(y)), F.lower(x)) == k + 1).alias("first"))), lambda s: s["first"])
    return F.slice(F.transform(fresh, lambda s: F.substring(s["t"], 1, 110)), 1, 3)


def hubs(metrics: DataFrame, edge: DataFrame, n: int = 20, most: int = 180) -> tuple[DataFrame, DataFrame]:
    """The pages with the most inlinks (then outlinks), and the edges among them."""
    w = Window.partitionBy("site").orderBy(F.desc("incoming"), F.desc("outgoing"), "key")
    top = metrics.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
    key = top.select("site", "key")
    inner = edge.join(key.withColumnRenamed("key", "src_key"), ["site", "src_key"], "left_semi").join(key.withColumnRenamed("key", "dst_key"), ["site", "dst_key"], "left_semi")
    w = Window.partitionBy("site").orderBy("src_key", "dst_key")
    return top, inner.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def linking_score(metrics: DataFrame, statuses: DataFrame) -> DataFrame:
    flag = lambda c: F.count_if(c).alias(c)
    site = metrics.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), *map(flag, ("orphan", "weak", "deep", "no_outgoing")))
    bad = statuses.groupBy("site").agg(F.count_if(F.col("kind") == "broken").alias("broken"), F.count_if(F.col("kind") == "redirect").alias("redirects"))
    both = site.join(bad, "site", "left").na.fill(0, ["broken", "redirects"])
    points = F.expr("8 * orphan + 2 * weak + 8 * broken + 2 * redirects + 2 * deep + 2 * no_outgoing")
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 - points / F.greatest(F.lit(1), 20 * F.col("pages")) * 100).cast("long")))
    return both.withColumn("score", score)


def coverage(pages: DataFrame, sitemap: DataFrame, homes: DataFrame, limited: Column | None = None) -> DataFrame:
    """Sitemap pages that were not crawled, errors, and whether the crawl is good enough for conclusions."""
    per = pages.groupBy("site").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("status_code") >= 400).alias("errors"))
    missing = sitemap.join(pages.select("site", "key"), ["site", "key"], "left_anti").groupBy("site").agg(F.count(F.lit(1)).alias("not_crawled"))
    home = homes.join(pages, ["site", "key"]).groupBy("site").agg(F.max((F.col("status_code") >= 200) & (F.col("status_code") < 400)).alias("home_crawled"))
    both = per.join(missing, "site", "left").join(home, "site", "left").na.fill(0, ["not_crawled"]).na.fill(False, ["home_crawled"])
    both = both.withColumn("limited", limited if limited is not None else F.lit(False))
    few = F.col("errors") <= F.greatest(F.lit(2), F.bround(F.greatest(F.lit(1), F.col("fetched")) * 0.05))
    both = both.withColumn("sufficient", F.col("home_crawled") & ~F.col("limited") & few)
    return both.withColumn("reason", F.when(F.col("sufficient"), "complete").when(F.col("limited"), "limit").when(~F.col("home_crawled"), "home").otherwise("errors"))


def ordered_report(metrics: DataFrame, flag: str | None = None, search: str | None = None) -> DataFrame:
    out = metrics.where(flag) if flag else metrics
    if search:
        out = out.where(F.lower("key").contains(search.lower()))
    return out.orderBy(F.desc("orphan"), F.desc("weak"), "incoming", "key")


def weakest(metrics: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("site").orderBy(F.desc("orphan"), "incoming", F.desc_nulls_first("depth"), "key")
    return metrics.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def work_items(metrics: DataFrame, statuses: DataFrame, shown: int = 30) -> DataFrame:
    """Orphans, broken links, weak and deep pages: how many, and the first of them."""
    flagged = [metrics.where(f).select("site", F.lit(f).alias("kind"), F.col("key").alias("item")) for f in ("orphan", "weak", "deep")]
    broken = statuses.where("kind = 'broken'").select("site", F.lit("broken").alias("kind"), F.concat("src_key", F.lit(" -> "), "dst_key").alias("item"))
    every = broken
    for f in flagged:
        every = every.unionByName(f)
    w = Window.partitionBy("site", "kind").orderBy("item")
    first = every.withColumn("r", F.row_number().over(w)).where(F.col("r") <= shown).groupBy("site", "kind").agg(F.array_join(F.array_sort(F.collect_list("item")), "|").alias("items"))
    priority = F.when(F.col("kind").isin("orphan", "broken"), "P1").when(F.col("kind") == "weak", "P2").otherwise("P3")
    return every.groupBy("site", "kind").agg(F.count(F.lit(1)).alias("n")).join(first, ["site", "kind"]).withColumn("priority", priority)
