"""Operator 11: Merkle manifest of a dataset, with a proof for every row.

Each row's digest is a leaf. Leaves of one source, in order of doc_id, form a tree of runs of FAN nodes; the sources'
roots, in order of source, form a tree above, whose root stands for the whole table.

A leaf's rank in its source is a number of base FAN. Blocks of FAN**DIGITS leaves are dealt out once; within a block the
rank's digits are grouped away one after the other without a further shuffle, each grouping nesting the structs of the one
before, so that a block ends as one row. Blocks are the leaves of the next tier. Going down again, a transform over the
nested arrays gives each node what lies left and right of it, and explode emits the nodes. Within a block there is no join; from
tier to tier the blocks, one for FAN**DIGITS nodes, take over the steps above them, as no single row could hold a source of
any size.

Ranks come from a range-partitioned sort over (source, doc_id, leaf) and counts of its partitions; so a source that holds a
third of all rows is dealt over many tasks. Null ids come first in their source, and of rows of one id that with the smaller
digest. Repeated rows are leaves of their own; which of them comes first makes no difference. A null, an empty and a very long
text are values like any other. Other columns play no part, whatever their names. An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitescope.llm import common
from sitescope.sources.tables import small

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
#: Digits of the rank that one block spans: it holds FAN**DIGITS nodes at most.
DIGITS = 3
#: Blocks whose steps are broadcast at most, of some five kilobytes each.
FEW = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TREE = ("unnamed", "name")


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def leaf(text: Column) -> Column:
    return digest(*(field_text(text if c == "text" else common.field(c)) for c in FIELDS))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, unnamed, name, leaf, start): ``start`` is what a proof is folded from: the leaf, or that of the tampered text."""
    text, source = common.field("text"), common.field("source")
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf(F.translate(text, UPPER, LOWER)))
    rows = docs.select(common.field("doc_id").alias("doc_id"), source.isNull().alias("unnamed"), F.coalesce(source.cast("string"), F.lit("")).alias("name"), leaf(text).alias("leaf"), changed.alias("changed"))
    return rows.select("doc_id", *TREE, "leaf", F.coalesce("changed", "leaf").alias("start"))


def ranked(rows: DataFrame) -> DataFrame:
    """The rows with ``rank`` in their source and ``n``, the rows of the source.

    Where a source begins is found per partition of the sort; that small table is joined back by partition and source, so
    no key holds more than a partition.
    """
    placed = common.in_order(rows, F.col("unnamed").desc(), F.col("name").asc(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc())
    seen = placed.groupBy("part", *TREE).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    source = Window.partitionBy(*TREE)
    begun = seen.select("part", *TREE, F.min("first").over(source).alias("first"), F.sum("n").over(source).alias("n"))
    return placed.join(begun, ["part", *TREE]).withColumn("rank", F.col("at") - F.col("first")).drop("part", "at", "first")


def _hashed(level: int) -> Column:
    """Whether a tree of n leaves still has several nodes at this level."""
    return F.col("n") > F.lit(FAN**level).cast("decimal(38,0)")


def blocks(nodes: DataFrame, level: int, *more: str) -> DataFrame:
    """(tree, n, block, digest, under): each block of nodes as nested arrays of structs, with its digest.

    ``nodes``: tree, n, rank, digest, and ``more`` columns that the innermost structs carry; ``level``: the nodes' height.
    """
    names = [f"d{k}" for k in range(DIGITS)]
    bits = FAN.bit_length() - 1
    digits = [F.shiftright("rank", bits * k).bitwiseAND(FAN - 1).cast("int").alias(name) for k, name in enumerate(names)]
    rows = nodes.select(*TREE, "n", F.shiftright("rank", bits * DIGITS).alias("block"), *digits, "digest", *more).repartition(*TREE, "block")
    inner = list(more)
    for k, name in enumerate(names):
        kids = F.array_sort(F.collect_list(F.struct(name, "digest", *inner)))
        rows = rows.groupBy(*TREE, "n", "block", *reversed(names[k + 1 :])).agg(kids.alias("kids"))
        joined = F.sha2(F.array_join(F.transform("kids", lambda x: x["digest"]), ""), 256)
        rows = rows.select(*TREE, "n", "block", *names[k + 1 :], F.when(_hashed(level + k), joined).otherwise(F.col("kids")[0]["digest"]).alias("digest"), F.col("kids").alias("under"))
        inner = ["under"]
    return rows


def step(kids: Column, at: Column) -> Column:
    """What stands left and right of a node in its run."""
    joined = lambda x: F.array_join(F.transform(x, lambda y: y["digest"]), "")
    return F.struct(joined(F.slice(kids, F.lit(1), at)).alias("left"), joined(F.slice(kids, at + 2, F.lit(FAN))).alias("right"))


def opened(found: DataFrame, level: int, *more: str) -> DataFrame:
    """The blocks' nodes again: tree, rank, what the blocks carry above, ``more``, and ``steps`` from the node to the root."""
    bits = FAN.bit_length() - 1
    carried = [c for c in found.columns if c not in ("block", "digest", "under", "steps")]
    rows = found.withColumn("rank", F.col("block"))
    for k in reversed(range(DIGITS)):
        each = F.explode(F.transform("under", lambda x, i: F.struct(x.alias("node"), step(F.col("under"), i).alias("step"))))
        rows = rows.select(*carried, "rank", "steps", each.alias("one"))
        here = F.when(_hashed(level + k), F.array("one.step")).otherwise(F.array().cast("array<struct<left:string,right:string>>"))
        below = ["one.node.under"] if k else ["one.node.digest", *(f"one.node.{c}" for c in more)]
        rows = rows.select(*carried, (F.shiftleft("rank", bits) + F.col(f"one.node.d{k}")).alias("rank"), F.concat(here, "steps").alias("steps"), *below)
    return rows


def tiers(nodes: DataFrame, most: int, *more: str) -> list[DataFrame]:
    """Blocks of the nodes, blocks of these, and so on until each tree is one block; ``most``: leaves of the largest tree."""
    made = [common.cut(blocks(nodes, 0, *more))]
    while FAN ** (DIGITS * len(made)) < most:
        above = made[-1].select(*TREE, "n", F.col("block").alias("rank"), "digest")
        made.append(common.cut(blocks(above, DIGITS * len(made))))
    return made


def downward(made: list[DataFrame], above: DataFrame, *more: str) -> DataFrame:
    """The lowest tier's nodes with all their steps; ``above``: tree, steps, and further columns of each tree."""
    now = made[-1].join(small(above, FEW), list(TREE))
    for k in reversed(range(len(made))):
        now = opened(now, DIGITS * k, *(more if k == 0 else ()))
        if k:
            told = now.drop("n", "digest").withColumnRenamed("rank", "block")
            now = made[k - 1].join(small(told, FEW), [*TREE, "block"])
    return now


def folded(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(steps, start, lambda now, x: digest(x["left"], now, x["right"]))


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row. Where ``tampered`` holds, the root is
    folded from the digest of the text with A-Z lower-cased."""
    rows = ranked(leaves(docs, tampered)).withColumnRenamed("leaf", "digest")
    most = rows.agg(F.max("n")).first()[0] or 0
    low = tiers(rows, most, "doc_id", "start")
    subroots = common.in_order(low[-1].select("unnamed", "name", "digest"), F.col("unnamed").desc(), F.col("name").asc())
    n = subroots.count()
    sources = subroots.select(F.lit(False).alias("unnamed"), F.lit("").alias("name"), F.lit(n).cast("long").alias("n"), F.col("at").alias("rank"), "digest", F.struct("unnamed", "name").alias("of"))
    high = tiers(sources, n, "of")
    root = next((r["digest"] for r in high[-1].collect()), None)  # one row
    nothing = high[-1].select(*TREE, F.array().cast("array<struct<left:string,right:string>>").alias("steps"))
    tops = downward(high, nothing, "of").select("of.unnamed", "of.name", F.col("digest").alias("subroot"), "steps")
    out = downward(low, tops, "doc_id", "start")
    siblings = F.array_join(F.transform("steps", lambda x: F.concat(x["left"], x["right"])), "")
    made = out.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("start"), F.col("steps")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return manifest(common.read(spark, sf_dir, "documents"), tampered)


_TEXT = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
_LEAF = lambda text: "sha256(" + " || ".join(_TEXT(text if c == "text" else c) for c in FIELDS) + ")"
_BESIDE = """coalesce(string_agg(dig, '' ORDER BY idx) OVER (PARTITION BY source, lvl, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(dig, '' ORDER BY idx) OVER (PARTITION BY source, lvl, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"""
_LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"
ORACLE_SQL = {
    "op11_merkle": f"""WITH RECURSIVE {common.CRC_SQL},
  doc AS (SELECT doc_id, source, leaf, start, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rk, count(*) OVER (PARTITION BY source) AS n
    FROM (SELECT doc_id, source, {_LEAF('text')} AS leaf, CASE WHEN {common.crc_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_LEAF(f'({_LOWERED})')} ELSE {_LEAF('text')} END AS start FROM documents, crc_table) d),
  up AS (SELECT source, n, 0 AS lvl, rk AS idx, leaf AS dig FROM doc
    UNION ALL SELECT source, n, lvl + 1, idx // 16, sha256(string_agg(dig, '' ORDER BY idx)) FROM up WHERE n > CAST(pow(16, lvl) AS BIGINT) GROUP BY source, n, lvl, idx // 16),
  sub AS (SELECT source, dig, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rk, count(*) OVER () AS n FROM (SELECT source, arg_max(dig, lvl) AS dig FROM up WHERE idx = 0 GROUP BY source) s),
  top AS (SELECT NULL AS source, n, 0 AS lvl, rk AS idx, dig FROM sub
    UNION ALL SELECT NULL, n, lvl + 1, idx // 16, sha256(string_agg(dig, '' ORDER BY idx)) FROM top WHERE n > CAST(pow(16, lvl) AS BIGINT) GROUP BY n, lvl, idx // 16),
  sl AS (SELECT source, lvl, idx, {_BESIDE} FROM up WHERE n > CAST(pow(16, lvl) AS BIGINT)),
  st AS (SELECT lvl, idx, {_BESIDE} FROM top WHERE n > CAST(pow(16, lvl) AS BIGINT)),
  f1 AS (SELECT doc_id, source, leaf, rk, 0 AS lvl, start AS cur, '' AS proof FROM doc
    UNION ALL SELECT f1.doc_id, f1.source, f1.leaf, f1.rk, f1.lvl + 1, sha256(l || cur || r), proof || l || r FROM f1 JOIN sl ON sl.source IS NOT DISTINCT FROM f1.source AND sl.lvl = f1.lvl AND sl.idx = f1.rk >> (4 * f1.lvl)),
  m1 AS (SELECT doc_id, leaf, source, rk, arg_max(cur, lvl) AS cur, arg_max(proof, lvl) AS proof FROM f1 GROUP BY doc_id, leaf, source, rk),
  f2 AS (SELECT doc_id, leaf, sub.dig AS subroot, sub.rk AS rk, m1.rk AS own, 0 AS lvl, cur, proof FROM m1 JOIN sub ON sub.source IS NOT DISTINCT FROM m1.source
    UNION ALL SELECT f2.doc_id, f2.leaf, f2.subroot, f2.rk, f2.own, f2.lvl + 1, sha256(l || cur || r), proof || l || r FROM f2 JOIN st ON st.lvl = f2.lvl AND st.idx = f2.rk >> (4 * f2.lvl)),
  m2 AS (SELECT doc_id, leaf, subroot, arg_max(cur, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM f2 GROUP BY doc_id, leaf, subroot, rk, own),
  rt AS (SELECT arg_max(dig, lvl) AS root FROM top WHERE idx = 0)
  SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM m2, rt""",
}
QUERIES = {"op11_merkle": op11_merkle}
