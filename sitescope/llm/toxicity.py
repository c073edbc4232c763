"""Operator 13: toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded words.

Words are folded first: compatibility forms and accents go, letters of other alphabets that look like Latin ones become
these, and digits and signs that stand for letters do, too (``l`` and ``i`` are one letter, as ``1`` may be either). The
lexicon holds beginnings of folded words and whole words that toxic documents of the labelled sample hold so much more often
than clean ones that chance is no explanation; each weighs by its log-odds. Exceptions are longer phrases - a whole word, or
a word with a neighbour - around a lexicon entry that clean documents use as often: they weigh nothing. The automaton finds
all entries at once, and of those that begin at one place the longest counts, so an exception takes the place of the entry
that it holds. The sum of weights, and the sum by length, go into a logistic curve fitted to the same sample.

The sample is bounded by LABELLED documents (the smallest hashes of their ids among those that may be learned from); texts
that are copies or near copies of each other count once in it. An id with both labels is toxic. Every document is scored,
whole. Without labels of both kinds there is no lexicon, and every score is 0.

Null, empty and wordless texts score as texts without a hit. Rows with null ids are scored, never learned from, and count as
not held out. Equal texts have equal scores, whatever their ids; repeated rows stay. Other columns play no part. An empty
table gives no rows. Very long texts are slices of their own; their folded form is held as a whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.llm import common

#: Documents that the lexicon and the curve are fitted on at most, and entries of the lexicon at most.
LABELLED = 20_000
ENTRIES = 5_000
LEAST = 0.3
#: An entry's log-odds must exceed STRONG by SURE standard errors; an exception's must stay below MILD by one.
STRONG, SURE, MILD = 1.2, 2.5, 0.7
#: Letters of the beginnings of words, and letters that a whole word in a phrase may have.
BEGIN, LONGEST, WHOLE = 4, 12, 40
#: A beginning is left out if one letter more keeps this share of its documents.
SAME = 0.9
MIN_DOCS = 4
#: Letters of other alphabets, digits and signs, with the Latin letter that each is read as.
ALIKE = (
    "а=a в=b е=e з=e и=i к=k м=m н=h о=o п=n р=p с=c т=t у=y х=x ѕ=s і=i ј=j һ=h ԁ=d ӏ=i ѵ=v ԛ=q ԝ=w α=a β=b ε=e ζ=z η=n ι=i κ=k ν=v ο=o ρ=p τ=t υ=u χ=x ı=i "
    "0=o 1=i 3=e 4=a 5=s 7=t 8=b 9=g @=a $=s !=i l=i"
)
_ALIKE = str.maketrans({a: b for a, _, b in (pair.partition("=") for pair in ALIKE.split())})
_WORD = re.compile(r"[@$]?[^\W_]+(?:[@$!]+[^\W_]+)*")
#: Combining accents, and characters that take no room.
_UNSEEN = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff]+")


def fold(text: str) -> str:
    """The text's folded words, each between two spaces of its own, so that neighbours do not share one."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).casefold()
        text = _UNSEEN.sub("", text)
    else:
        text = text.lower()
    words = (w for w in _WORD.findall(text) if not w.isdigit())
    return f" {'  '.join(words)} ".translate(_ALIKE)


def words_of(folded: str) -> list[str]:
    return folded.split()


def beginnings(words: set[str]) -> set[str]:
    """The patterns that a document's words offer: beginnings after a space, and whole words."""
    out = set()
    for w in words:
        out.update(f" {w[:k]}" for k in range(BEGIN, min(len(w), LONGEST) + 1))
        if len(w) <= WHOLE:
            out.add(f" {w} ")
    return out


def log_odds(a, b, n_toxic: int, n_clean: int):
    """Log-odds of a pattern and their standard error, from the toxic and clean documents that hold it."""
    return np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1)), np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


class Lexicon:
    """Patterns with weights; built into an automaton once in each worker."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.automaton = weights, None

    def __getstate__(self):
        return {"weights": self.weights, "automaton": None}

    def hits(self, folded: str) -> list[tuple[int, str]]:
        """(end, pattern) of the longest entries, from left to right, none overlapping."""
        if not self.weights:
            return []
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for pattern in self.weights:
                self.automaton.add_word(pattern, pattern)
            self.automaton.make_automaton()
        return list(self.automaton.iter_long(folded))

    def measures(self, folded: str) -> tuple[float, int]:
        """(sum of the weights found, words)."""
        return math.fsum(self.weights[p] for _, p in self.hits(folded)), len(folded.split())


def predictors(total, words) -> np.ndarray:
    """What the curve sees of each document: weight found, weight by length, and length."""
    total, words = np.asarray(total, float), np.maximum(np.asarray(words, float), 1)
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / words), np.log1p(words) * (total > 0)], axis=1)


def fitted_curve(x: np.ndarray, toxic: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Coefficients of a logistic curve, by Newton's steps."""
    at = np.zeros(x.shape[1])
    for _ in range(50):
        p = curve(x, at)
        slope = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(at))
        move = np.linalg.solve(slope, x.T @ (toxic - p) - ridge * at)
        at += move
        if np.abs(move).max() < 1e-9:
            break
    return at


def curve(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ at, -50, 50)))


def labelled_texts(docs: DataFrame, labels: DataFrame, held_out: Column, limit: int) -> DataFrame:
    """(toxic, folded) of at most ``limit`` labelled documents. Of the texts of one id one stays, and so does one of the copies
    and near copies of one label: those whose least shingle of three words, by hash, is the same."""
    known = labels.select(common.field("doc_id").alias("doc_id"), common.field("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~F.coalesce(held_out, F.lit(False))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = common.cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    texts = docs.select(common.field("doc_id").alias("doc_id"), common.field("text").alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches):
        for batch, found in common.slices(batches):
            folded = [fold(t.decode("utf-8", "replace")) for t in found]
            hashes, owner = common.word_hashes([t.encode("utf-8") for t in folded])
            first, value = common.grams(hashes, owner, 3)
            mark = np.full(len(found), np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(mark, owner[first], value)
            short = np.bincount(owner, minlength=len(found)) < 3
            mark[short] = [zlib.crc32(t.encode("utf-8")) for t, s in zip(folded, short) if s]
            yield common.with_columns(batch, ("doc_id", "toxic"), mark=mark.view(np.int64), folded=folded)

    sent = texts.select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, toxic int, mark long, folded string")
    of_id = sent.groupBy("doc_id", "toxic").agg(F.min(F.struct("mark", "folded")).alias("one"))
    return common.cut(of_id.groupBy("toxic", "one.mark").agg(F.min("one.folded").alias("folded")).select("toxic", "folded"))


def pattern_counts(sample: DataFrame, offered) -> DataFrame:
    """(pattern, toxic, clean): documents of each kind that offer a pattern."""

    def run(batches):
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for toxic, folded in zip(batch.column("toxic").to_pylist(), batch.column("folded").to_pylist()):
                counts[toxic > 0].update(offered(folded))
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield from _counted(counts)
                    counts = (Counter(), Counter())
            yield from _counted(counts)

    sent = sample.select("toxic", "folded").mapInArrow(run, "pattern string, toxic long, clean long")
    return sent.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _counted(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
    patterns = list(counts[0].keys() | counts[1].keys())
    for lo in range(0, len(patterns), 50_000):
        own = patterns[lo : lo + 50_000]
        yield pa.RecordBatch.from_pydict({"pattern": own, "toxic": pa.array([counts[1][p] for p in own], pa.int64()), "clean": pa.array([counts[0][p] for p in own], pa.int64())})


def learned(sample: DataFrame, n_toxic: int, n_clean: int, entries: int = ENTRIES) -> dict[str, float]:
    """The lexicon's entries with their weights, the exceptions among them with 0."""
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    strong = pattern_counts(sample, lambda t: beginnings(set(words_of(t)))).where(F.col("toxic") >= MIN_DOCS).where(odds - SURE * error > STRONG)
    found = {r[0]: (r[1], r[2]) for r in strong.orderBy(F.col("toxic").desc(), "pattern").limit(entries).collect()}
    longer = Counter()
    for pattern, (toxic, _) in found.items():
        if not pattern.endswith(" "):
            longer[pattern[:-1]] = max(longer[pattern[:-1]], toxic)
    kept = {p: n for p, n in found.items() if longer[p] < SAME * n[0]}
    weights = {}
    for pattern, n in kept.items():
        w, e = log_odds(*n, n_toxic, n_clean)
        weights[pattern] = round(float(w - e), 4)
    base = Lexicon(weights)

    def phrases(folded: str) -> set[str]:
        """Whole words that an entry begins, alone and with a neighbour."""
        out = set()
        words = [w if len(w) <= WHOLE else "" for w in words_of(folded)]
        for before, w, after in zip(["", *words], words, [*words[1:], ""]):
            if w and base.hits(f" {w} "):
                out.update((f" {w} ", *([f" {before}  {w} "] if before else []), *([f" {w}  {after} "] if after else [])))
        return out

    mild = pattern_counts(sample, phrases).where(F.col("clean") >= MIN_DOCS).where(odds + error < MILD)
    for r in mild.orderBy(F.col("clean").desc(), "pattern").limit(entries).collect():
        weights[r[0]] = 0.0
    return weights


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, limit: int = LABELLED) -> tuple[Lexicon, np.ndarray | None]:
    """The lexicon and the curve's coefficients; no curve without labels of both kinds."""
    sample = labelled_texts(docs, labels, held_out, limit)
    n = {bool(r[0]): r[1] for r in sample.groupBy(F.col("toxic") > 0).count().collect()}
    if len(n) < 2:
        return Lexicon({}), None
    lexicon = Lexicon(learned(sample, n[True], n[False]))
    measured = measures(sample, lexicon, "toxic").collect()  # at most ``limit`` rows of numbers
    toxic, total, words = (np.array(c, float) for c in zip(*((r["toxic"] > 0, r["total"], r["words"]) for r in measured)))
    return lexicon, fitted_curve(predictors(total, words), toxic)


def measures(sample: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """(keep..., total, words) of folded texts."""

    def run(batches):
        for batch in batches:
            total, words = zip(*(lexicon.measures(t) for t in batch.column("folded").to_pylist())) if batch.num_rows else ((), ())
            yield common.with_columns(batch, keep, total=pa.array(total, pa.float64()), words=pa.array(words, pa.int64()))

    kinds = ", ".join(f"{c} {sample.schema[c].dataType.simpleString()}" for c in keep)
    return sample.select(*keep, "folded").mapInArrow(run, f"{kinds}, total double, words long")


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column, least: float = LEAST, limit: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; ``held_out``: a condition on doc_id for what is never learned from."""
    lexicon, at = fit(docs, labels, held_out, limit)

    def run(batches):
        for batch, texts in common.slices(batches):
            found = [lexicon.measures(fold(t.decode("utf-8", "replace"))) for t in texts]
            total, words = (np.array(c, float) for c in zip(*found))
            score = np.zeros(len(texts)) if at is None else curve(predictors(total, words), at)
            yield common.with_columns(batch, ("doc_id", "held_out"), score=score)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(common.field("doc_id").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), common.field("text").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= least).cast("int"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2
    return score_documents(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"), held_out)


QUERIES = {"op13_toxicity": op13_toxicity}
ORACLE_SQL: dict[str, str] = {}
