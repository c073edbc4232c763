"""Operator 4: quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams: the raw corpus (every document) and a trusted target (documents
labelled good). A document's score is its mean log ratio per n-gram. The threshold is one number, fixed from labelled
documents that the target did not see, and every document is compared with it.

All labels count: the documents of one half of the ids train the target, those of the other half set the threshold. Labels
meet their documents by joins, those of the target as masks of 64 neighbouring ids, so that texts stay where they are (beyond
MASKS of them the texts of that half are shuffled); the threshold's order statistics are found by narrowing counts.

Null and empty texts have no words, so they fail the base rules. Repeated rows get equal results, rows of equal score
equal verdicts (a score at the threshold is kept). Rows with a null id are judged like any other, but no label speaks of
them. An empty table gives no rows. Without usable labels the method has no verdict and only the base rules reject. Texts
are taken in slices of bounded bytes; memory follows the longest text.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.llm import common
from sitescope.sources.tables import small

SYMBOLS = b"#*$%&|<>"
BUCKETS = 1 << 16
#: Weight of the raw corpus in the target's smoothing, in n-grams per bucket.
PRIOR = 0.5
#: Share of held-out good documents that the threshold may lose.
LOSS = 0.002
MIN_WORDS = 50
#: Masks that are broadcast at most (so many take 21 MB); dense ids need one for 64 of them.
MASKS = 1 << 19
_DROP = bytes(c for c in range(256) if c not in SYMBOLS)


def base_stats(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text, and the words' hashes and owners."""
    n = len(texts)
    hashes, owner = common.word_hashes(texts)
    n_words = np.bincount(owner, minlength=n)
    chars, symbols, dup = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        solid = text.translate(None, b" \t\n\v\f\r")
        chars[i] = len(solid) if solid.isascii() else len(solid.decode("utf-8", "surrogatepass"))
        symbols[i] = len(text.translate(None, _DROP))
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        dup[i] = len(lines) - len(set(lines))
    repeat = np.zeros(len(hashes), dtype=bool)
    at, value = common.grams(hashes, owner, 3)
    if len(at):
        key = common.mix(value + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(3):
            repeat[at[twice] + j] = True
    return n_words, chars, symbols, dup, np.bincount(owner[repeat], minlength=n), hashes, owner


def features(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, owner) of each unigram and bigram."""
    at, pair = common.grams(hashes, owner, 2)
    bits = np.uint64(64 - int(math.log2(BUCKETS)))
    return np.concatenate([hashes >> bits, pair >> bits]).astype(np.int64), np.concatenate([owner, owner[at]])


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of every labelled document, once; conflicting labels count as bad."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))


def _fit_half(doc_id) -> bool:
    return (int(doc_id) * 2654435761 >> 7) % 2 == 0


#: _fit_half() of a column: bit 7 of the product follows from the lowest 8 bits of both factors.
FIT_HALF = f"((cast(doc_id as bigint) & 255) * {2654435761 & 255} >> 7) & 1 = 0"


def count_features(docs: DataFrame) -> np.ndarray:
    """Counts of the documents' n-grams by bucket."""
    width = 1024

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, texts in common.slices(batches):
            bucket, _ = features(*common.word_hashes(texts))
            total += np.bincount(bucket, minlength=BUCKETS)
        for block in range(BUCKETS // width):
            part = total[block * width : (block + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": np.full(width, block, "int32"), "k": np.arange(width, dtype="int32"), "n": part})

    out = np.zeros(BUCKETS)
    rows = docs.select("text").mapInArrow(count, "block int, k int, n long").groupBy("block", "k").agg(F.sum("n"))
    for block, k, n in rows.collect():  # at most BUCKETS rows
        out[block * width + k] = n
    return out


def trusted_texts(docs: DataFrame, known: DataFrame, most: int = MASKS) -> DataFrame:
    """The texts of documents that train the target: labelled good, and of the half that fits."""
    block, bit = F.expr("cast(doc_id as bigint) >> 6").alias("block"), F.expr("cast(cast(doc_id as bigint) & 63 as int)").alias("bit")
    masks = known.where("quality = 1").where(FIT_HALF).select(block, bit).groupBy("block").agg(F.expr("bit_or(1L << bit)").alias("mask"))
    return docs.where(FIT_HALF).select("text", block, bit).join(small(masks, most), "block").where("(mask >> bit) & 1 = 1").select("text")


def fit(docs: DataFrame, labels: DataFrame | None) -> tuple[np.ndarray, DataFrame | None]:
    """(log ratio per bucket, held-out labels)."""
    known = labelled(labels) if labels is not None else None
    every = count_features(docs)
    trusted = count_features(trusted_texts(docs, known)) if known is not None else np.zeros(BUCKETS)
    raw = (every + 0.5) / (every.sum() + 0.5 * BUCKETS)
    good = (trusted + PRIOR * BUCKETS * raw) / (trusted.sum() + PRIOR * BUCKETS)
    return np.log(good / raw), known.where(f"not ({FIT_HALF})") if known is not None else None


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def judge(texts: list[bytes], ratio: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns of SCORED for some texts."""
    *stats, hashes, owner = base_stats(texts)
    bucket, of = features(hashes, owner)
    n = np.bincount(of, minlength=len(texts))
    return *stats, np.bincount(of, weights=ratio[bucket], minlength=len(texts)) / np.maximum(n, 1)


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id with the base statistics and the mean log ratio per n-gram."""
    names = [c.split()[0] for c in SCORED.split(", ")]

    def run(batches):
        for batch, texts in common.slices(batches):
            yield common.with_columns(batch, ("doc_id",), **dict(zip(names, judge(texts, ratio))))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCORED}")


def threshold(scores: list[tuple[float, int]]) -> float:
    """The cut that separates good (1) from bad (0) best, losing at most LOSS of the good; -inf without both kinds."""
    good = np.sort([s for s, q in scores if q == 1])
    bad = np.sort([s for s, q in scores if q == 0])
    if not len(good) or not len(bad):
        return -math.inf
    most = good[int(LOSS * len(good))]
    below = bad[bad < most]
    if not len(below):
        return -math.inf
    top = below[-1]
    return midway(top, good[0], good[np.searchsorted(good, top)], most)


def midway(top: float, first: float, after: float, most: float) -> float:
    """Between the last bad score under the bound, ``top``, and the least good one above it, ``after``; the bound, ``most``,
    where all good scores, from ``first`` on, lie above."""
    return float((top + (after if first < top else most)) / 2)


def kth_least(values: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """The value with ``k`` values below it in order. Counts by ranges of values narrow it down to one value."""
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    while lo < hi:
        own = F.col(column).between(lo, hi)
        place = F.least(F.floor((F.col(column) - lo) / F.lit(hi - lo) * bins), F.lit(bins - 1)).alias("bin")
        for _, n, lo, hi in sorted(values.where(own).groupBy(place).agg(F.count(F.lit(1)), F.min(column), F.max(column)).collect()):  # at most ``bins`` rows
            if k < n:
                break
            k -= n
    return lo


def _held_out_threshold(scored: DataFrame, held_out: DataFrame | None) -> float:
    """threshold() of the held-out documents with words enough, of each its least score."""
    if held_out is None:
        return -math.inf
    judged = scored.where(f"n_words >= {MIN_WORDS}").join(held_out, "doc_id").groupBy("doc_id").agg(F.min("score").alias("score"), F.min("quality").alias("quality"))
    judged = common.cut(judged.select("score", "quality"))
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    n = good.count()
    if not n:
        return -math.inf
    most = kth_least(good, "score", int(LOSS * n))
    top = bad.where(F.col("score") < most).agg(F.max("score")).first()[0]
    if top is None:
        return -math.inf
    first, after = good.agg(F.min("score"), F.min(F.when(F.col("score") >= top, F.col("score")))).first()
    return midway(top, first, after, most)


def rejected(n_words, n_repeat_words):
    """The base rules, for columns and for arrays."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def fitted(docs: DataFrame, labels: DataFrame | None) -> tuple[np.ndarray, float, DataFrame]:
    """(log ratio per bucket, threshold, scored documents)."""
    ratio, held_out = fit(docs, labels)
    scored = common.cut(score(docs, ratio))
    return ratio, _held_out_threshold(scored, held_out), scored


def assess(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """One row per document: doc_id, base statistics, base_failed, score, kept."""
    _, least, scored = fitted(docs, labels)
    failed = rejected(F.col("n_words"), F.col("n_repeat_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= F.lit(least)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep_good(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The documents that assess() keeps, with all their columns. Only texts go to the workers, a second time, rather than
    joining scores back: no shuffle, and columns of any name and type stay as they are."""
    ratio, least, _ = fitted(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text), bool)
        texts = common.as_bytes(text)
        for at in range(0, len(texts), common.BATCH_ROWS):
            part = slice(at, at + common.BATCH_ROWS)
            n_words, _, _, _, repeat, value = judge(texts[part], shared.value)
            out[part] = ~rejected(n_words, repeat) & (value >= least)
        return pd.Series(out)

    return docs.where(good(common.field("text")))


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLE_SQL: dict[str, str] = {}
