"""URL functions on columns. All are plain expressions, so filters and keys stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitescope.functions import grams as G
from sitescope.sources.tables import settled, small

#: RFC 3986, appendix B. parse_url() is stricter: it gives null for spaces and bad escapes.
PARTS = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"

# Fixed values.
PAGE_KEYS = ("page", "paged", "pageno", "page_number")
ASSETS = (
    "jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "ico", "bmp", "tif", "tiff", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "zip", "rar", "7z", "gz", "css", "js", "mjs", "json", "xml", "txt", "csv", "mp3", "wav", "mp4", "webm", "avi",
    "woff", "woff2", "ttf", "otf", "eot",
)
MEDIA_DIRS = ("/wp-content/uploads/", "/wp-content/plugins/", "/wp-content/themes/")
SERVICE_KEYS = ("ajax", "ajax_action", "action", "callback", "handler", "endpoint", "wc-ajax")
SERVICE_DIR = r"/(includes?|inc|ajax|api|handlers?|endpoints?)(/|$)"
SERVICE_NAME = r"(^|[-_.])(ajax|endpoint|handler|callback|include|inc|api|feed|cron)([-_.]|$)"
VERIFICATION = r"^(yandex_[a-z0-9_-]+|google[a-z0-9_-]+)\.html$"
PHP_SERVICE = r"(_inc|-inc|include|ajax|handler|endpoint|callback|tab\.php)"
PUBLICATION_DIRS = ("news", "novosti", "articles", "article", "stati")


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def part(url, k: int) -> Column:
    return F.regexp_extract(F.coalesce(c(url), F.lit("")), PARTS, k)


def scheme(url) -> Column:
    return part(url, 1)


def authority(url) -> Column:
    return part(url, 2)


def path(url) -> Column:
    return part(url, 3)


def query(url) -> Column:
    return part(url, 4)


def fragment(url) -> Column:
    return part(url, 5)


def clean(text) -> Column:
    """Runs of white space become one space; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c(text), F.lit("")), r"(?U)\s+", " "))


def normalize_url(url) -> Column:
    """Trimmed, with a scheme; null without a host."""
    text = clean(url)
    full = F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    return F.when((text != "") & (authority(full) != ""), full)


def host(url, port: bool = True) -> Column:
    name = F.regexp_replace(F.lower(authority(url)), r"^www\.", "")
    return name if port else F.element_at(F.split(name, ":"), 1)


def clean_path(url) -> Column:
    """Path without parameters and doubled slashes; empty is the root."""
    bare = F.regexp_replace(path(url), r";[^/]*$", "")
    return F.regexp_replace(F.when(bare == "", F.lit("/")).otherwise(bare), "/{2,}", "/")


def kept_query(url) -> Column:
    """Only the parameters that number pages, in their order."""
    name = lambda x: F.lower(F.element_at(F.split(x, "=", 2), 1))
    items = F.filter(F.split(query(url), "&"), lambda x: name(x).isin(*PAGE_KEYS))
    value = lambda x: F.url_encode(F.coalesce(F.try_url_decode(F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit(""))), F.lit("")))
    return F.array_join(F.transform(items, lambda x: F.concat(F.element_at(F.split(x, "=", 2), 1), F.lit("="), value(x))), "&")


def _joined(url, path_: Column) -> Column:
    head = F.lower(F.when(scheme(url) == "", F.lit("https")).otherwise(scheme(url)))
    tail = kept_query(url)
    return F.concat(head, F.lit("://"), host(url), path_, F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("?"), tail)))


def page_key(url) -> Column:
    """Identity of a page in the link graph."""
    p = clean_path(url)
    return _joined(url, F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", "")))


def display_link(url) -> Column:
    """As page_key(), with a trailing slash kept."""
    return _joined(url, clean_path(url))


def compare_url(url) -> Column:
    """Scheme, host, unusual port and path."""
    s = F.lower(F.when(scheme(url) == "", F.lit("https")).otherwise(scheme(url)))
    name = F.regexp_replace(F.lower(authority(url)), "^.*@", "")
    usual = ((s == "https") & name.endswith(":443")) | ((s == "http") & name.endswith(":80"))
    name = F.when(usual, F.regexp_replace(name, ":[0-9]+$", "")).otherwise(name)
    p = clean_path(url)
    full = F.concat(s, F.lit("://"), name, F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", "")))
    return F.when(F.coalesce(c(url), F.lit("")) == "", F.lit("")).otherwise(full)


def last_segment(url) -> Column:
    return F.element_at(F.split(path(url), "/"), -1)


def is_page(url) -> Column:
    low = F.lower(F.when(path(url) == "", F.lit("/")).otherwise(path(url)))
    suffix = F.regexp_extract(F.element_at(F.split(low, "/"), -1), r"\.([^.]*)$", 1)
    media = F.lit(False)
    for d in MEDIA_DIRS:
        media = media | low.contains(d)
    return ~media & ~suffix.isin(*ASSETS) & F.lower(scheme(url)).isin("http", "https")


def glob_regex(pattern: Column) -> Column:
    """A glob of * and ? (and [...]) as a regular expression for the whole text."""
    quoted = F.regexp_replace(pattern, r"([\\.^$+(){}|])", r"\\$1")
    quoted = F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", ".")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(quoted, r"\[!", "[^"), F.lit("$"))


def excludes(url, pattern) -> Column:
    """Whether one exclusion pattern hits the URL: a glob, ``?`` and a piece of the query, or a piece of the URL."""
    p = F.lower(F.trim(c(pattern)))
    low = F.lower(c(url))
    target = F.lower(F.concat(path(url), F.when(query(url) == "", F.lit("")).otherwise(F.concat(F.lit("?"), query(url)))))
    is_glob = p.contains("*") | (p.contains("?") & ~p.startswith("?"))
    by_glob = F.regexp_like(target, glob_regex(p)) | F.regexp_like(low, glob_regex(p))
    by_query = F.lower(query(url)).contains(F.substring(p, 2, 10_000))
    return (p != "") & F.when(is_glob, by_glob).when(p.startswith("?"), by_query).otherwise(target.contains(p) | low.contains(p))


def literal_parts(pattern) -> Column:
    """What every address that the pattern hits must contain: the pieces of a glob between its signs, else the pattern."""
    p = F.lower(F.trim(c(pattern)))
    is_glob = p.contains("*") | (p.contains("?") & ~p.startswith("?"))
    pieces = F.when(is_glob, F.split(F.regexp_replace(p, r"\[[^\]]*\]|\[", "*"), "[*?]+")).otherwise(F.array(F.regexp_replace(p, "^[?]", "")))
    return F.filter(pieces, lambda x: x != "")


def drop_excluded(urls: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """URLs that no pattern of their site (or a pattern without a site) hits.

    A pattern is filed under the run of four characters, out of its literal pieces, that the fewest addresses hold (shorter
    pieces under themselves). Addresses, each once, fetch the patterns of such runs that they hold, and only these are tried. Patterns
    without a literal piece are tried on every address of their site.
    """
    rules = patterns.select(F.col("site").alias("of"), F.trim("pattern").alias("pattern")).where("pattern <> ''").distinct()
    offered = rules.select("of", "pattern", F.explode(F.flatten(F.transform(literal_parts("pattern"), lambda x: G.runs_of(x)))).alias("run"))
    own = urls.select("site", F.col(url).alias("address")).where("address is not null").distinct()
    low = F.lower(c("address"))
    lengths = sorted(r[0] for r in offered.select(F.length("run")).distinct().collect())  # RUN rows at most
    runs = F.array_distinct(F.flatten(F.array(*(G.runs_of(low, k) for k in lengths)))) if lengths else F.array().cast("array<string>")
    held = own.select("site", "address", F.explode(runs).alias("run"))
    counts = held.join(small(offered.select("run").distinct()), "run").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    filed = small(settled(G.rarest(offered, counts, "of", "pattern")))
    hit = excludes(F.col("address"), F.col("pattern"))
    fetched = held.join(filed.where("of is not null").withColumnRenamed("of", "site"), ["site", "run"]).unionByName(held.join(filed.where("of is null").drop("of"), "run"))
    anywhere = rules.where(F.size(literal_parts("pattern")) == 0)
    broad = own.join(small(anywhere), F.col("of").isNull() | (F.col("of") == F.col("site"))).select("site", "address", "pattern")
    gone = fetched.select("site", "address", "pattern").unionByName(broad).where(hit).select(F.col("site").alias("__site"), F.col("address").alias("__address")).distinct()
    return urls.join(gone, F.col("site").eqNullSafe(F.col("__site")) & (F.col(url) == F.col("__address")), "left_anti")


def segments(url) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def section(url) -> Column:
    """``/`` up to one segment, else the first one."""
    bare = F.regexp_replace(path(url), "^/+|/+$", "")
    return F.when(bare.contains("/"), F.concat(F.lit("/"), F.element_at(F.split(bare, "/"), 1), F.lit("/"))).otherwise(F.lit("/"))


def template_scope(url) -> Column:
    s = segments(url)
    low = F.transform(s, lambda x: F.lower(x))
    first = F.get(low, F.lit(0))
    at = F.array_position(low, "blog")
    join = lambda n: F.concat(F.lit("/"), F.array_join(F.slice(s, 1, n), "/"), F.lit("/"))
    return (
        F.when(F.size(s) == 0, F.lit("/"))
        .when(first.isin("catalog", "katalog") & (F.size(s) >= 2), join(2))
        .when(at > 0, join(at.cast("int")))
        .otherwise(join(1))
    )


def slug_words(url) -> Column:
    bare = F.regexp_replace(path(url), "^/+|/+$", "")
    return F.regexp_replace(F.element_at(F.split(bare, "/"), -1), "[-_]+", " ")


def looks_like_url(text) -> Column:
    t = F.trim(F.coalesce(c(text), F.lit("")))
    return ~t.rlike(r"\s") & t.rlike(r"(?i)^https?://[^/?#]+")


def import_key(url) -> Column:
    """Identity of an imported URL: lower scheme and host, no fragment."""
    q = query(url)
    return F.concat(F.lower(scheme(url)), F.lit("://"), F.lower(authority(url)), F.when(path(url) == "", F.lit("/")).otherwise(path(url)), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))


def classify_imports(rows: DataFrame, domain, order: str = "pos") -> DataFrame:
    """Each imported row with its class: invalid, other_domain, duplicate or kept (the first of its key)."""
    kind = F.when(~looks_like_url("raw_value"), "invalid").when(host("raw_value", port=False) != c(domain), "other_domain")
    keyed = rows.withColumn("__kind", kind).withColumn("key", import_key(F.trim("raw_value")))
    first = keyed.where("__kind is null").groupBy("key").agg(F.min(order).alias("__first"))
    both = keyed.join(first, "key", "left")
    return both.withColumn("class", F.coalesce("__kind", F.when(F.col(order) == F.col("__first"), "kept").otherwise("duplicate"))).drop("__kind", "__first")


def matches_lists(url, include: list[str], exclude: list[str]) -> Column:
    low = F.lower(c(url))
    every = lambda xs: F.array(*(F.lit(x.lower()) for x in xs)).cast("array<string>")
    return F.forall(every(include), lambda x: low.contains(x)) & ~F.exists(every(exclude), lambda x: low.contains(x))


def technical_signals(url, content_type, ordinary=None) -> Column:
    """Signs that a URL is not an ordinary page, each once; ``ordinary``: whether the parsed HTML looks like a page."""
    low = F.lower(path(url))
    name = F.element_at(F.split(low, "/"), -1)
    keys = F.transform(F.split(query(url), "&"), lambda x: F.lower(F.element_at(F.split(x, "=", 2), 1)))
    php = name.endswith(".php") & (low.rlike(SERVICE_DIR) | name.rlike(PHP_SERVICE))
    kind = F.coalesce(c(content_type), F.lit(""))
    found = F.array(
        F.when(F.arrays_overlap(keys, F.array(*map(F.lit, SERVICE_KEYS))), "service_query"),
        F.when(name.rlike(VERIFICATION), "verification_file"),
        F.when(low.rlike(SERVICE_DIR), "service_directory"),
        F.when(name.rlike(SERVICE_NAME), "service_name"),
        F.when(php, "service_php"),
        F.when((kind != "") & ~F.lower(kind).contains("html"), "not_html"),
        F.when(~c(ordinary), "not_a_page") if ordinary is not None else F.lit(None).cast("string"),
    )
    return F.array_compact(found)


def extension(url) -> Column:
    return F.lower(F.regexp_extract(last_segment(url), r"\.([^.]+)$", 1))


def pasted_urls(text) -> Column:
    """Distinct http(s) URLs of a pasted list, in order."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c(text), F.lit("")), r"[\s,;]+"), lambda x: x.rlike("(?i)^https?://")))


def group_by_section(urls: DataFrame) -> DataFrame:
    return urls.groupBy("site", section("url").alias("section")).agg(F.count(F.lit(1)).alias("n_urls")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n_urls"), "section")).cast("long")
    )
