"""Texts against briefs: each document is checked by the phrases and figures of its own brief.

Documents are (doc_id, brief_id, text), requirements (brief_id, requirement, phrase, min, max). Words of documents make a
positional index, of those stems alone that some brief asks for; it is joined with the phrases' words on brief and stem, so a
document meets no phrase of another brief, and a phrase no document that lacks its words. Places where all words of a
phrase follow each other in one sentence are matches. For independent occurrences each document's matches are claimed in
turn: longer phrases first, then by requirement, then by place; a word is claimed once.

A document is an id with a brief and a text: rows that repeat count once, and null ids are one id. Null and empty texts,
unknown and null briefs, and phrases without words have no matches. A document's matches are gathered in one row, as its
text is.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitescope.functions import words as W
from sitescope.operators.texts import words
from sitescope.sources.tables import small

#: Stems that workers take along to index these words only; with more, all words are indexed and the join chooses.
WANTED = 200_000
DOC = ("doc_id", "brief_id", "version")
MATCH = ("first", "last", "exact", "start", "end", "sentence")


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, brief_id, version, text): ``version`` tells texts of one id apart."""
    return docs.select("doc_id", "brief_id", F.xxhash64("text").alias("version"), "text").dropDuplicates(list(DOC))


def phrase_words(requirements: DataFrame) -> DataFrame:
    """(brief_id, requirement, size, offset, norm, stem): one row a word of a phrase."""

    @F.pandas_udf("array<struct<norm:string,stem:string>>")
    def parts(phrase):
        return phrase.map(lambda p: [{"norm": W.normal_word(x), "stem": W.stem(x)} for x in re.findall(W.WORD, p or "")])

    rows = requirements.where("brief_id is not null").select("brief_id", "requirement", parts("phrase").alias("parts"))
    return rows.select("brief_id", "requirement", F.size("parts").alias("size"), F.posexplode("parts").alias("offset", "part")).select("brief_id", "requirement", "size", "offset", "part.*")


def matches(docs: DataFrame, requirements: DataFrame, forms: bool = True) -> DataFrame:
    """(doc_id, brief_id, version, requirement, size, first, last, exact, start, end, sentence) of every match, also of those that overlap."""
    asked = phrase_words(requirements)
    stems = [r["stem"] for r in asked.select("stem").distinct().limit(WANTED + 1).collect()]
    wanted = frozenset(stems) if len(stems) <= WANTED else None
    index = W.tokenize(documents(docs), keep=DOC, wanted=wanted)
    found = index.join(small(asked.withColumnRenamed("norm", "asked")), ["brief_id", "stem"])
    whole = found.groupBy(*DOC, "requirement", "size", (F.col("idx") - F.col("offset")).alias("first")).agg(
        F.count(F.lit(1)).alias("n"), F.max("idx").alias("last"), F.bool_and(F.col("norm") == F.col("asked")).alias("exact"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("sentence").alias("sentence"), F.max("sentence").alias("until"),
    )
    whole = whole.where((F.col("n") == F.col("size")) & (F.col("sentence") == F.col("until")))
    return (whole if forms else whole.where("exact")).select(*DOC, "requirement", "size", *MATCH)


def independent(found: DataFrame) -> DataFrame:
    """The matches that hold when each word is claimed once: (doc_id, brief_id, version, requirement, first, last, ...)."""
    order = F.struct((-F.col("size")).alias("longest"), "requirement", "first", "last", "exact", "start", "end", "sentence")
    lists = found.groupBy(*DOC).agg(F.array_sort(F.collect_list(order)).alias("found"))

    def claim(batches):
        for batch in batches:
            owner, rows = [], []
            for k, own in enumerate(batch.column("found").to_pylist()):
                taken: set[int] = set()
                for m in own:
                    span = range(m["first"], m["last"] + 1)
                    if taken.isdisjoint(span):
                        taken.update(span)
                        owner.append(k)
                        rows.append(m)
            kept = [batch.column(c).take(pa.array(owner, pa.int32())) for c in DOC]
            kinds = (pa.int32(), *[pa.bool_() if c == "exact" else pa.int32() for c in MATCH])
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([m[c] for m in rows], t) for c, t in zip(("requirement", *MATCH), kinds))], [*DOC, "requirement", *MATCH])

    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in DOC)
    claimed = ", ".join(f"{c} {'boolean' if c == 'exact' else 'int'}" for c in MATCH)
    return lists.mapInArrow(claim, f"{kinds}, requirement int, {claimed}")


def counted(docs: DataFrame, asked: DataFrame, found: DataFrame) -> DataFrame:
    """Each document's own requirements with ``n``, how often each is found."""
    every = documents(docs).drop("text").join(small(asked), "brief_id")
    n = found.groupBy(*DOC, "requirement").agg(F.count(F.lit(1)).alias("n"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"n.{c}")) if c != "requirement" else F.col("e.requirement") == F.col("n.requirement") for c in (*DOC, "requirement")]
    return every.alias("e").join(n.alias("n"), on=[x for x in same], how="left").select("e.*", F.coalesce("n.n", F.lit(0)).alias("n"))


def keyword_status(docs: DataFrame, requirements: DataFrame, claimed: DataFrame) -> DataFrame:
    """(doc_id, brief_id, requirement, phrase, n, status, delta): what is missing, enough or in excess."""
    c = F.col
    status = F.when(c("n") < c("min"), "missing").when(c("n") > c("max"), "excess").otherwise("ok")
    delta = F.when(c("n") < c("min"), c("min") - c("n")).when(c("n") > c("max"), c("n") - c("max")).otherwise(0)
    return counted(docs, requirements, claimed).select(*DOC, "requirement", "phrase", "n", status.alias("status"), delta.cast("long").alias("delta"))


def spacing(claimed: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, left, right, gap): neighbouring occurrences in one sentence with fewer than ``least`` other words between them."""
    w = Window.partitionBy(*DOC).orderBy("first", "last")
    both = claimed.select("*", *(F.lag(c).over(w).alias(f"{c}_before") for c in ("last", "sentence", "requirement")))
    gap = F.col("first") - F.col("last_before") - 1
    close = both.where((F.col("sentence") == F.col("sentence_before")) & (gap < least))
    return close.select(*DOC, F.col("requirement_before").alias("left"), F.col("requirement").alias("right"), F.greatest(F.lit(0), gap).cast("long").alias("gap"))


def coverage(docs: DataFrame, phrases: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, requirement, phrase, n, found): how often each phrase of the brief's list occurs, overlaps counted."""
    return counted(docs, phrases, found).select(*DOC, "requirement", "phrase", "n", (F.col("n") > 0).alias("found"))


def volume(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_chars, word_delta, char_delta, too_short) against the brief's figures; null where it has none."""
    chars = F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))).cast("long")
    n = F.coalesce(F.size(words("text")), F.lit(0)).cast("long")
    own = documents(docs).select(*DOC, F.greatest(n, F.lit(0)).alias("n_words"), chars.alias("n_chars"))
    both = own.join(small(targets.select("brief_id", "words", "chars")), "brief_id", "left")
    least = F.greatest(F.lit(1), F.floor(F.col("words") * 0.85))
    short = F.coalesce((F.col("words") > 0) & (F.col("n_words") < least), F.lit(False))
    return both.select(*DOC, "n_words", "n_chars", (F.col("words") - F.col("n_words")).alias("word_delta"), (F.col("chars") - F.col("n_chars")).alias("char_delta"), short.alias("too_short"))


def _flag(condition: Column, name: str) -> Column:
    return F.when(condition, name)


def readiness(status: DataFrame, gaps: DataFrame, lists: DataFrame, volumes: DataFrame) -> DataFrame:
    """(doc_id, missing, excess, spacing, missing_lsi, issues, ready) of every document, by one grouping of all findings."""
    n = lambda c, name: c.cast("long").alias(name)
    zero = lambda *names: [F.lit(0).cast("long").alias(x) for x in names]
    delta = lambda kind: F.when(F.col("status") == kind, F.col("delta")).otherwise(0)
    parts = (
        status.select(*DOC, n(delta("missing"), "missing"), n(delta("excess"), "excess"), *zero("spacing", "missing_lsi", "short"))
        .unionByName(gaps.select(*DOC, *zero("missing", "excess"), n(F.lit(1), "spacing"), *zero("missing_lsi", "short")))
        .unionByName(lists.select(*DOC, *zero("missing", "excess", "spacing"), n((~F.col("found")).cast("int"), "missing_lsi"), *zero("short")))
        .unionByName(volumes.select(*DOC, *zero("missing", "excess", "spacing", "missing_lsi"), n(F.col("too_short").cast("int"), "short")))
    )
    names = ("missing", "excess", "spacing", "missing_lsi", "short")
    every = parts.groupBy(*DOC).agg(*(F.sum(c).alias(c) for c in names))
    issues = F.array_compact(F.array(*(_flag(F.col(c) > 0, x) for c, x in zip(names, ("missing", "excess", "spacing", "lsi", "short")))))
    return every.select(*DOC, *names[:-1], F.array_join(issues, ",").alias("issues"), (F.size(issues) == 0).alias("ready"))


def requirements_of(briefs: DataFrame) -> DataFrame:
    """(brief_id, requirement, phrase, min, max) of parsed briefs, in their order."""
    rows = briefs.select("brief_id", F.posexplode("keywords").alias("requirement", "k"))
    return rows.select("brief_id", "requirement", "k.phrase", "k.min", "k.max")


def lists_of(briefs: DataFrame, column: str = "lsi") -> DataFrame:
    """(brief_id, requirement, phrase) of a list of parsed briefs."""
    return briefs.select("brief_id", F.posexplode(column).alias("requirement", "phrase"))
