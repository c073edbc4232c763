"""Operator 9: exact Jaccard join of word n-gram sets by grouped prefixes.

Shingles are put in one global order, rare ones first (by a fixed-size table of counts over the whole corpus), and a
set's prefix is so many of its first shingles that two linked sets must share one. Documents with equal sets collapse
to one set; sets with equal prefixes and sizes to one group. Groups that share a prefix shingle are compared by sizes,
by the shingles' places, and by how their shingles spread over the hash range (the most of any member), each an exact
upper bound on what any two members can share. Only pairs that pass are expanded to the groups' members and verified on whole sets.

In a place where many groups meet, the first round tries each with one centre only: the group with the fewest rarer
shingles before this one, such as the text that others were copied from with changes. That connects copies of one text.
A second round tries every pair of the place that is still unconnected. So no link between components is lost
and the pairs within a component are never all made.

Documents without words (null, empty, white space) have no set and link with nothing. Fewer words than a shingle make
one shingle. Repeated rows are equal sets, and so are rows of one id with other texts each a set of their own. A document
with a null id belongs to its component but does not name it; alone it has a null component. An empty table gives no rows.
Texts are taken in slices of bounded bytes; a very long text needs memory for its own set. Set identities and shingles
are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.llm import common

SHINGLE = 4
#: Link if DEN * intersection >= NUM * union.
NUM, DEN = 85, 100
#: Entries of the table of shingle counts; of fixed size, whatever the corpus.
ORDER_BITS = 21
SPREAD = 64
#: Places with more groups than this go through a centre first.
FEW = 8
#: A set of ids is broadcast up to this size, and joined by shuffling beyond.
BROADCAST_IDS = 200_000


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of each text's shingles, with repeats; A-Z lower-cased."""
    hashes, owner = common.word_hashes([t.translate(common.ASCII_LOWER) for t in texts])
    at, value = common.grams(hashes, owner, k)
    of = owner[at]
    n_words = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        first = np.cumsum(n_words) - n_words
        value = np.concatenate([value, common.Spans(hashes).of(first[short], first[short] + n_words[short])])
        of = np.concatenate([of, short])
    return value, of


def distinct_sets(value: np.ndarray, of: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) without repeats, ordered by owner, then rank, then hash."""
    order = np.lexsort((value, of) if rank is None else (value, rank, of))
    value, of = value[order], of[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (of[1:] != of[:-1])] if len(value) else np.zeros(0, bool)
    return value[new], of[new]


def shingle_ranks(docs: DataFrame, k: int, bits: int = ORDER_BITS, fan: int = 256) -> np.ndarray:
    """Rank of each of 2**bits classes of shingles: half the logarithm of how many (document, shingle) pairs it has.

    Tasks send their counts in blocks; of each block up to ``fan`` groups of tasks are added up first, then the groups, so
    no group holds the blocks of all tasks.
    """
    width = 1 << 12

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for _, texts in common.slices(batches):
            value, _ = distinct_sets(*shingles(texts, k))
            total += np.bincount((value >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        yield from common.count_blocks(total, width, TaskContext.get().partitionId() % fan)

    ranks = np.zeros(1 << bits, np.uint8)
    for block, found in common.added_up(docs.select("text").mapInArrow(count, "block int, part int, counts binary"), width).collect():  # 2**bits numbers in all
        ranks[block * width : (block + 1) * width] = np.floor(2 * np.log2(np.maximum(common.unpack(found, np.int64), 1))).astype(np.uint8)
    return ranks


def set_ids(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Identity of each non-empty set, given its shingles one set after the other."""
    has = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[has]
    scrambled = common.mix(value + np.uint64(0x9E3779B97F4A7C15))
    return common.mix(np.add.reduceat(scrambled, first) ^ n[has].astype(np.uint64)).view(np.int64) if len(has) else np.zeros(0, np.int64)


def prefix_sets(docs: DataFrame, ranks: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """One row per document: doc_id, a hash of its text, its set's size, identity, group and prefix, and the shingles'
    spread over the hash range."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # 2**ORDER_BITS bytes
    bits = len(ranks).bit_length() - 1

    def run(batches):
        for batch, texts in common.slices(batches):
            m = len(texts)
            value, of = shingles(texts, k)
            value, of = distinct_sets(value, of, shared.value[(value >> np.uint64(64 - bits)).astype(np.int64)])
            n = np.bincount(of, minlength=m)
            first, has = np.cumsum(n) - n, np.flatnonzero(n)
            spread = np.bincount(of * SPREAD + (value >> np.uint64(58)).astype(np.int64), minlength=m * SPREAD).astype(np.int32)
            scrambled = common.mix(value + np.uint64(0x9E3779B97F4A7C15))
            set_id, group_id = np.zeros(m, np.int64), np.zeros(m, np.uint64)
            set_id[has] = set_ids(value, n)
            length = np.where(n > 0, n - -(-num * n // den) + 1, 0)
            for i in has:
                group_id[i] = common.mix(scrambled[first[i] : first[i] + length[i]].sum(keepdims=True) + np.uint64(n[i]))[0]
            ends = np.cumsum(length)
            inside = np.arange(ends[-1] if m else 0) - np.repeat(ends - length, length) + np.repeat(first, length)
            made = {
                "n": n.astype(np.int32), "set_id": set_id, "group_id": group_id.view(np.int64),
                "prefix": pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(value[inside].view(np.int64))),
                "spread": pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * SPREAD, SPREAD, dtype=np.int32)), pa.array(spread)),
            }
            yield common.with_columns(batch, ("doc_id", "key"), **made)

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    return ids.mapInArrow(run, "doc_id long, key long, n int, set_id long, group_id long, prefix array<long>, spread array<int>")


def _may_link(na: Column, nb: Column, pa: Column, pb: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes that first meet at these places can still link."""
    need = F.ceil(num * (na + nb) / F.lit(den + num))
    return (den * F.least(na, nb) >= num * F.greatest(na, nb)) & (1 + F.least(na - pa, nb - pb) - 1 >= need)


def _within(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids; the ids are broadcast only if few enough."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


class Join:
    """One join: the tables that its rounds share."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.docs, self.k, self.num, self.den = docs, k, num, den
        self.rows = common.cut(prefix_sets(docs, shingle_ranks(docs, k), k, num, den))
        full = self.rows.where("n > 0")
        self.sets = common.cut(full.groupBy("set_id").agg(F.first("n").alias("n"), F.first("group_id").alias("group_id"), F.min("doc_id").alias("doc_id")))
        groups = full.groupBy("group_id").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        # members share their prefix only: in each range of hashes a group has as many shingles as its fullest member
        most = full.groupBy("group_id").agg(*(F.max(F.get("spread", F.lit(k))).alias(f"s{k}") for k in range(SPREAD)))
        self.spreads = common.cut(most.select("group_id", F.array(*(f"s{k}" for k in range(SPREAD))).alias("spread")))
        placed = groups.select("group_id", "n", F.posexplode("prefix").alias("pos", "shingle"))
        met = placed.groupBy("shingle").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
        self.places = common.cut(placed.join(met, "shingle"))

    def near(self, pairs: DataFrame) -> DataFrame:
        """Distinct group pairs (a, b) whose spreads allow a link."""
        spread = lambda c: self.spreads.select(F.col("group_id").alias(c), F.col("spread").alias(f"s{c}"))
        both = pairs.select("a", "b", "na", "nb").distinct().join(spread("a"), "a").join(spread("b"), "b")
        most = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
        return both.where(most >= F.ceil(self.num * (F.col("na") + F.col("nb")) / F.lit(self.den + self.num))).select("a", "b")

    def pairs_of(self, left: DataFrame, right: DataFrame, on: str) -> DataFrame:
        side = lambda df, c: df.select(on, F.col("group_id").alias(c), F.col("n").alias(f"n{c}"), F.col("pos").alias(f"p{c}"), *(F.col(x).alias(f"{x}_{c}") for x in df.columns if x in ("label",)))
        return side(left, "a").join(side(right, "b"), on).where(_may_link(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"), self.num, self.den))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the set pairs that link, by their whole sets."""
        pairs, n = common.cut_counting(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
        if not n:
            return pairs
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        holders = self.rows.where("n > 0").join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("d"))
        # each wanted set has a row, so these are the wanted ones
        holders, unnamed = common.cut_counting(holders.select("set_id", "d.doc_id"), "doc_id is null")
        named = holders.select("doc_id").where("doc_id is not null").distinct()
        texts = _within(self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), named)
        if unnamed:
            texts = texts.union(self.docs.where("doc_id is null").select(F.lit(None).cast("long"), "text"))
        k = self.k

        def full(batches):
            for _, texts in common.slices(batches):
                value, of = distinct_sets(*shingles(texts, k))
                n = np.bincount(of, minlength=len(texts))
                n = n[n > 0]
                items = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(value, n)), items], ["set_id", "items"])

        items = texts.select("text").mapInArrow(full, "set_id long, items array<long>").join(holders, "set_id", "left_semi")
        items = common.cut(items.dropDuplicates(["set_id"]))
        side = lambda c: items.select(F.col("set_id").alias(c), F.col("items").alias(f"i{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        common_n = F.size(F.array_intersect("ia", "ib"))
        return both.where(self.den * common_n >= self.num * (F.size("ia") + F.size("ib") - common_n)).select("a", "b")

    def expand(self, group_pairs: DataFrame, sets: DataFrame, *more: str) -> DataFrame:
        """(a, b) of the groups' member sets; of each also the columns ``more``, such as label_a and label_b."""
        member = lambda c: sets.select(F.col("group_id").alias(c), F.col("set_id").alias(f"m{c}"), *(F.col(x).alias(f"{x}_{c}") for x in more))
        return group_pairs.join(member("a"), "a").join(member("b"), "b").select(F.col("ma").alias("a"), F.col("mb").alias("b"), *(f"{x}_{c}" for c in "ab" for x in more))

    def labelled(self) -> DataFrame:
        """The sets with a label each, equal for all that link, directly or through others."""
        small = self.places.where(F.col("met") <= FEW)
        large = self.places.where(F.col("met") > FEW)
        centres = large.groupBy("shingle").agg(F.min(F.struct("pos", "group_id", "n")).alias("c")).select("shingle", "c.*")
        pairs = self.pairs_of(small, small, "shingle").where("a < b").select("a", "b", "na", "nb")
        star = self.pairs_of(large, centres, "shingle").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
        tried = common.cut(self.near(pairs.union(star)))
        crowd = self.sets.groupBy("group_id").agg(F.count(F.lit(1)).alias("sets"), F.min("set_id").alias("b")).where("sets > 1")
        inner = self.sets.join(crowd, "group_id").select(F.col("set_id").alias("a"), "b").where("a <> b")
        label = common.components(self.verify(self.expand(tried, self.sets).union(inner)))
        first = common.cut(self.sets.join(label, self.sets["set_id"] == label["node"], "left").select("set_id", "group_id", "doc_id", F.coalesce("component", "set_id").alias("label")))
        left, n = self.unconnected(large, first, tried)
        if not n:
            return first
        # links of the second round lead from component to component
        bridges = self.verify(left).join(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "label_a", "label_b"), ["a", "b"])
        joined = common.components(bridges, "label_a", "label_b")
        return first.join(joined, first["label"] == joined["node"], "left").select("set_id", "group_id", "doc_id", F.coalesce("component", "label").alias("label"))

    def unconnected(self, large: DataFrame, labelled: DataFrame, tried: DataFrame) -> tuple[DataFrame, int]:
        """(a, b, label_a, label_b) of set pairs of crowded places and groups that the first round neither tried nor connected,
        and their number."""
        # a group whose sets are all in one component stands for them
        mixed = labelled.groupBy("group_id").agg(F.min("label").alias("label"), F.max("label").alias("top"))
        marked = large.join(mixed, "group_id").withColumn("label", F.when(F.col("label") == F.col("top"), F.col("label"))).drop("top")
        open_places = marked.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count_if(F.col("label").isNull()).alias("unsure")).where("lo < hi or unsure > 0").select("shingle")
        marked = common.cut(marked.join(open_places, "shingle", "left_semi"))
        pairs = self.pairs_of(marked, marked, "shingle").where("a < b and (label_a is null or label_b is null or label_a <> label_b)").select("a", "b", "na", "nb")
        outer = self.expand(self.near(pairs).join(tried, ["a", "b"], "left_anti"), labelled, "label")
        several = mixed.where("label < top").select("group_id")
        own = labelled.join(several, "group_id", "left_semi")
        side = lambda c: own.select("group_id", F.col("set_id").alias(c), F.col("label").alias(f"label_{c}"))
        inner = side("a").join(side("b"), "group_id").where("a < b").select("a", "b", "label_a", "label_b")
        return common.cut_counting(outer.union(inner).where("label_a <> label_b"))


def classified(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, key, n, label, component_id), one row per document; ``label`` tells components apart, also unnamed ones."""
    join = Join(docs, k, num, den)
    named = join.labelled()
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = named.select("set_id", "label").join(least, "label").select("set_id", "label", "component_id")
    rows = join.rows.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"))
    return common.join_spread(rows, of, "set_id").select("doc_id", "key", "n", "label", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def similar_documents(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    return classified(docs, k, num, den).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One row of each component, with all its columns: the least by doc_id (null last), then by a hash of the text.

    Rows are told apart by id and text, so of rows with one id each text has its own fate; of rows that repeat both, one
    stays. Rows without words all stay.
    """
    rows = common.cut(classified(docs, k, num, den).where("n > 0").select("doc_id", "key", "label"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    first = rows.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").select("label", "first")
    judged = common.join_spread(rows, first, "label").where("first is not null")
    own = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.key") == F.col("key"))
    gone = judged.where(~own).select("doc_id", "key").distinct()
    kept = common.wrapped(docs, common.field("doc_id").cast("long").alias("id"), F.xxhash64(common.field("text")).alias("key"))
    kept = kept.join(gone.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    # rows that repeat the first one's id and text: seldom any, so only these are looked at again
    repeated = common.cut(judged.where(own).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(F.col("doc_id").alias("again_id"), F.col("key").alias("again_key")))
    if repeated.isEmpty():
        return common.unwrapped(kept, docs.columns)
    same = F.col("id").eqNullSafe(F.col("again_id")) & (F.col("key") == F.col("again_key"))
    alone, several = kept.join(repeated, same, "left_anti"), kept.join(repeated, same, "left_semi")
    return common.unwrapped(alone.unionByName(several.dropDuplicates(["id", "key"])), docs.columns)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(common.read(spark, sf_dir, "documents"))


QUERIES = {"op9_jaccard": op9_jaccard}
ORACLE_SQL = {
    "op9_jaccard": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {SHINGLE} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {SHINGLE - 1}], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1)) AS i FROM d WHERE len(w) > 0) x
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DEN} * c >= {NUM} * (x.n + y.n - c)
), sym AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, a AS r FROM sym UNION SELECT doc_id, b FROM reach JOIN sym ON sym.a = r
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least(m.r, d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id"""
}
