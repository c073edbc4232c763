"""Operator 7: URL rules found through their rarest literal token.

A rule is a regular expression over host + path, with the literal tokens that any URL it fits must hold. The corpus of
URLs says how often each token occurs; a rule is filed under its rarest one. A URL is cut into tokens, the tokens fetch
candidate rules, and only those rules' expressions run. The rule table is a parameter; beyond MAX_RULES it is not
broadcast but joined by token.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed. Repeated pages are judged
one by one; ties between equally long rules of one priority go to block, then to the rule's text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.llm import common

#: Fixed values of the contract: (verdict, host, path).
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The method's own rules for URLs that no host rule fits: (verdict, literal tokens, expression over host + path).
PATTERN_RULES = (
    ("block", ("casino",), "(^|[./_-])casino([./_-]|$)"),
    ("block", ("porn",), "(^|[./_-])porn([./_-]|$)"),
    ("block", ("viagra",), "(^|[./_-])viagra([./_-]|$)"),
    ("block", ("ads",), "^ads[.]|/ads/"),
    ("block", ("tracker",), "(^|[./_-])tracker([./_-]|$)"),
    ("block", ("m", "net"), "^m[.]([^/]*[.])?net/"),
    ("block", ("login",), "/login([/.]|$)"),
    ("allow", ("org",), "[.]org/"),
)
MAX_RULES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1))


def rule_table(spark: SparkSession, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """(rule, verdict, priority, length, literals, pattern): the host rules go before the pattern rules."""
    rows = []
    for verdict, host, path in host_rules:
        literal = re.findall("[A-Za-z0-9]+", host)
        inner = path.rstrip("/").split("/")[1:] if path.endswith("/") else path.split("/")[1:-1]
        literal += [x for part in inner for x in re.findall("[A-Za-z0-9]+", part)]
        quoted = lambda s: re.sub(r"([^A-Za-z0-9/])", r"[\1]", s)
        rows.append((host + path, verdict, 1, len(host + path), literal, f"^([^/]*[.])?{quoted(host)}{quoted(path)}"))
    rows += [(pattern, verdict, 0, len(pattern), list(literal), pattern) for verdict, literal, pattern in pattern_rules]
    return spark.createDataFrame(rows, "rule string, verdict string, priority int, length int, literals array<string>, pattern string")


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules with ``token``: their literal that the fewest URLs hold (then the longest, then by text)."""
    literal = rules.select(F.explode("literals").alias("token")).distinct()
    held = urls.select(F.explode(F.array_distinct(tokens(F.col("target")))).alias("token"))
    counts = held.join(F.broadcast(literal), "token", "left_semi").groupBy("token").count()
    each = rules.select("rule", "verdict", "priority", "length", "pattern", F.explode("literals").alias("token"))
    best = F.struct(F.coalesce("count", F.lit(0)).alias("n"), (-F.length("token")).alias("short"), F.col("token").alias("token"))
    return each.join(counts, "token", "left").groupBy("rule", "verdict", "priority", "length", "pattern").agg(F.min(best)["token"].alias("token"))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, host, path, best): best is the winning rule's struct (priority, length, blocks, rule, verdict), or null.

    Each row keeps its own identity through the token join, so repeated keys and URLs stay apart.
    """
    urls = pages.select(F.col(key).alias("key"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("target", F.concat("host", "path"))
    filed = index_rules(rules, urls)
    small = rules.count() <= MAX_RULES
    distinct = urls.select("target").where("target <> ''").distinct()
    fetched = distinct.select("target", F.explode(F.array_distinct(tokens(F.col("target")))).alias("token"))
    fetched = fetched.join(F.broadcast(filed) if small else filed, "token").where(F.expr("rlike(target, pattern)"))
    best = F.max(F.struct("priority", "length", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")).alias("best")
    return urls.join(fetched.groupBy("target").agg(best), "target", "left").select(F.col("key").alias(key), "host", "path", "best")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(common.read(spark, sf_dir, "pages"), rule_table(spark))
    fixed = F.col("best.priority") == 1
    return judged.select(
        "page_id", "host", "path", F.when(fixed, F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.when(~fixed, F.col("best.rule")).alias("pattern"),
    )


def _oracle() -> str:
    fits = lambda host, path: f"((host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}'))"
    order = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in order)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in order)
    more = sorted(PATTERN_RULES, key=lambda r: (-len(r[2]), r[0] != "block", r[2]))
    own = " ".join(f"WHEN regexp_matches(host || path, '{p}') THEN '{p}'" for _, _, p in more)
    own_verdict = " ".join(f"WHEN regexp_matches(host || path, '{p}') THEN '{v}'" for v, _, p in more)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), ruled AS (
  SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS fixed FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN fixed ELSE coalesce(CASE {own_verdict} END, 'allow') END AS verdict,
  CASE WHEN rule IS NULL THEN CASE {own} END END AS pattern FROM ruled"""


QUERIES = {"op7_url_filters": op7_url_filters}
ORACLE_SQL = {"op7_url_filters": _oracle()}
