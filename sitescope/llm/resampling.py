"""Operator 12: importance resampling towards a target distribution, by bit-sliced sums.

Words fall into BUCKETS by their checksum. The raw corpus and the target each give counts of the buckets, and a bucket's gain
is the floored, scaled logarithm of the ratio of the two smoothed shares. A document's weight is the sum of the gains of its
features. It is computed on bit planes: bit j of all bucket counts of a document is one plane of BUCKETS bits, bit k of the
gains' magnitudes another for each sign; the ones of their AND, times 2**(j + k) and the sign, add up to the exact integer.

The draw takes the highest scores (weight plus Gumbel noise from a hash of the id) among documents of enough words. Ranks
come from a range-partitioned sort and counts of its partitions, so no task holds all documents.

Null and empty texts have no features, weight 0, and are never drawn. A null id hashes as the empty string and comes last
among equal scores. Of rows with equal scores and ids that with fewer features comes first; rows that repeat are drawn one by
one. Very long texts are slices of their own; a document's planes are as many as its largest count has bits. Other columns play
no part. An empty table gives no rows; an empty target leaves the smoothed shares of the corpus alone.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.llm import common

BUCKETS = 10_000
SCALE = 1000
MIN_WORDS = 20
#: Share of the eligible documents that is drawn, in hundredths.
PERCENT = 10
SEED = 2024
#: 64-bit words of a plane.
_WIDTH = -(-BUCKETS // 64)
#: Letters, digits and all that is not ASCII make words; everything else separates.
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def bucket_counts(text: bytes) -> np.ndarray:
    """How many features of a text fall into each bucket."""
    words = Counter(text.translate(_KEPT).split())
    bucket = np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, len(words))
    return np.bincount(bucket, weights=np.fromiter(words.values(), np.float64, len(words)), minlength=BUCKETS).astype(np.int64)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative integers, lowest first: one row of packed bits for each."""
    bits = int(values.max(initial=0)).bit_length()
    ones = (values[None, :] >> np.arange(bits)[:, None] & 1).astype(np.uint8)
    padded = np.zeros((bits, _WIDTH * 8), np.uint8)
    packed = np.packbits(ones, axis=1)
    padded[:, : packed.shape[1]] = packed
    return padded.view(np.uint64)


def gain_planes(gains: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The planes of the gains, positive ones first, and what a one in each stands for."""
    up, down = planes(np.maximum(gains, 0)), planes(np.maximum(-gains, 0))
    return np.concatenate([up, down]), [1 << k for k in range(len(up))] + [-(1 << k) for k in range(len(down))]


def weight_of(counts: np.ndarray, gains: tuple[np.ndarray, list[int]]) -> int:
    """The exact sum of counts times gains."""
    own, (of, worth) = planes(counts), gains
    ones = np.bitwise_count(own[:, None, :] & of[None, :, :]).sum(axis=2, dtype=np.int64)
    return sum((1 << j) * sum(w * int(x) for w, x in zip(worth, row)) for j, row in enumerate(ones))


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """Features of all texts by bucket; tasks send their sums."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, texts in common.slices(batches):
            for text in texts:
                total += bucket_counts(text)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    sent = docs.select(common.field("text").alias("text")).mapInArrow(count, "bucket int, n long")
    for bucket, n in sent.groupBy("bucket").agg(F.sum("n")).collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain, in doubles, floored."""
    s_all, t_all = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(SCALE * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight) of every row."""
    gains = gains_of(corpus_counts(docs), corpus_counts(target))
    shared = docs.sparkSession.sparkContext.broadcast(gain_planes(gains))  # BUCKETS numbers

    def weigh(batches):
        for batch, texts in common.slices(batches):
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for k, text in enumerate(texts):
                counts = bucket_counts(text)
                n[k], weight[k] = counts.sum(), weight_of(counts, shared.value)
            yield common.with_columns(batch, ("doc_id",), n_features=n, weight=weight)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(common.field("doc_id").alias("doc_id"), common.field("text").alias("text")).mapInArrow(weigh, f"doc_id {kind}, n_features long, weight long")


def noise(doc_id: Column) -> Column:
    """Scaled Gumbel noise from the id's hash, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ``rank`` is null for what is not drawn."""
    scored = common.cut(weights(docs, target).withColumn("score", F.col("weight") + noise(F.col("doc_id"))))
    fit = F.col("n_features") >= MIN_WORDS
    drawn = percent * scored.where(fit).count() // 100
    placed = common.in_order(scored, fit.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc())
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("at") < drawn, F.col("at") + 1).alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_GUMBEL = "CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT)"
ORACLE_SQL = {
    "op12_resampling": f"""WITH {common.CRC_SQL}, dw AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
  v AS (SELECT w, {common.crc_sql('w')} % {BUCKETS} AS b FROM (SELECT DISTINCT w FROM dw UNION SELECT w FROM bw) x, crc_table),
  s AS (SELECT b, count(*) AS s FROM dw JOIN v USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM bw JOIN v USING (w) GROUP BY b),
  g AS (SELECT s.b, CAST(floor({SCALE} * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (ss + {BUCKETS}) / ((CAST(s AS DOUBLE) + 1) * (tt + {BUCKETS})))) AS BIGINT) AS gain
    FROM s LEFT JOIN t ON t.b = s.b, (SELECT CAST(count(*) AS DOUBLE) AS ss FROM dw), (SELECT CAST(count(*) AS DOUBLE) AS tt FROM bw)),
  e AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM dw JOIN v USING (w) JOIN g USING (b) GROUP BY doc_id),
  a AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight FROM documents LEFT JOIN e USING (doc_id)),
  c AS (SELECT *, weight + CAST(floor(-{SCALE} * ln(-ln(({_GUMBEL} + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM a),
  r AS (SELECT *, row_number() OVER (ORDER BY n_features >= {MIN_WORDS} DESC, score DESC, doc_id) AS k, count(*) FILTER (WHERE n_features >= {MIN_WORDS}) OVER () AS n_fit FROM c)
  SELECT doc_id, n_features, weight, score, CASE WHEN k <= n_fit * {PERCENT} // 100 THEN k END AS rank FROM r""",
}
QUERIES = {"op12_resampling": op12_resampling}
