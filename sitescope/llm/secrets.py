"""Operator 1: secrets in texts, by fixed patterns and a battery of randomness tests.

Long words are tried against two hypotheses, each with its own false-discovery control over all words of a length class.
The first is that the word's letters are random: the battery (chi-squared uniformity over the inferred encoding's
alphabet, runs about its middle, lag-one serial correlation) gives a p-value, and a step-up rule over the corpus'
p-values says which words are not random (RANDOM_LOST bounds the share of random ones among these). The second is that
the word is ordinary text: a character chain learned from the whole corpus gives a likelihood ratio, which bounds that
p-value (P(ratio >= t) <= 1/t under text), so length counts by itself; again a step-up rule sets the threshold
(FALSE_DISCOVERY). Words that the first rule leaves and the second rejects are reported.

Null or empty texts give no spans, an empty table no rows. Words with equal evidence are reported or left together. Random
spans overlap neither each other nor a base span. Rows are judged one by one, so repeated rows give repeated
results and null ids are like any other. Texts are taken in slices of bounded bytes; memory follows the longest text.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.llm import common

#: The three base kinds, in their order.
ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

#: Words tested by the battery: runs of these characters, at least MIN_LENGTH long; cut by tries() if no encoding holds one.
MIN_LENGTH = 16
WORD = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
PIECE = re.compile(rb"[^=]+=*")
ONE_ENCODING = (re.compile(rb"[A-Za-z0-9+/]{16,}=*"), re.compile(rb"[A-Za-z0-9_-]{16,}=*"))
LENGTH_CLASSES = (16, 20, 24, 32, 48, 64)
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Step-up rates: random words among those that the battery rejects, and ordinary ones among those reported.
RANDOM_LOST = 0.002
FALSE_DISCOVERY = 1e-4
#: The battery's p-values are kept in quarter decades up to this many.
BATTERY_STEPS = 64
#: Evidence is kept in steps of 1/4 decade up to this many steps.
STEPS = 400
_INDEX = {}
for _name, _letters in ALPHABETS:
    _row = np.full(256, -1, np.int16)
    _row[np.frombuffer(_letters.encode(), np.uint8)] = np.arange(len(_letters))
    _INDEX[_name] = (_row, len(_letters))
_HEX_RUN = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_LONG_RUN = bytes(104 if re.match(rb"[A-Za-z0-9+/_=-]", bytes([c])) else 32 for c in range(256))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, leftmost non-overlapping for each kind, failing matches dropped."""
    found = []
    low = text.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"apikey" in low or b"api_key" in low:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"h" * 32 in text.translate(_HEX_RUN):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def encoding(word: bytes) -> tuple[str, np.ndarray, int] | None:
    """The smallest alphabet that holds the word without its padding, and its letters' places there."""
    body = np.frombuffer(word.rstrip(b"="), np.uint8)
    for name, (row, size) in _INDEX.items():
        at = row[body]
        if len(at) and at.min() >= 0:
            return name, at, size
    return None


def tries(word: bytes) -> list[tuple[int, int, tuple[str, np.ndarray, int]]]:
    """(start, end, encoding) of what is tested: the word, or, if no encoding holds it, its parts between inner "=", and of
    parts that mix the two base64 alphabets the longest runs of each, apart from each other."""
    if enc := encoding(word):
        return [(0, len(word), enc)]
    out = []
    for m in PIECE.finditer(word):
        if m.end() - m.start() < MIN_LENGTH:
            continue
        if enc := encoding(m.group()):
            out.append((m.start(), m.end(), enc))
            continue
        out += [(m.start() + s, m.start() + e, encoding(m.group()[s:e])) for s, e in disjoint_runs(m.group())]
    return out


def disjoint_runs(word: bytes) -> list[tuple[int, int]]:
    """The runs of each base64 alphabet, the longest first (of equal ones the leftmost); where one meets a longer one only
    what lies outside of that counts, if it is still long enough. So no letter is tested twice."""
    kept: list[tuple[int, int]] = []
    left = sorted({r.span() for one in ONE_ENCODING for r in one.finditer(word)}, key=lambda x: (x[0] - x[1], x[0]))
    while left:
        start, end = left.pop(0)
        kept.append((start, end))
        rest = (x for s, e in left for x in ((s, min(e, start)), (max(s, end), e)))
        left = sorted({x for x in rest if x[1] - x[0] >= MIN_LENGTH and encoding(word[x[0] : x[1]])}, key=lambda x: (x[0] - x[1], x[0]))
    return sorted(kept)


def _upper_chi(x: float, k: int) -> float:
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(at: np.ndarray, size: int) -> float:
    """Corrected p-value of uniformity, runs and serial correlation under uniform random letters."""
    n = len(at)
    bins = max(2, min(size, n // 5))
    count = np.bincount(at.astype(np.int64) * bins // size, minlength=bins)
    share = np.bincount(np.arange(size) * bins // size, minlength=bins) / size
    chi = float((((count - n * share) ** 2) / (n * share)).sum())
    high = at >= size // 2
    n1, n0 = int(high.sum()), int(n - high.sum())
    if n1 and n0 and n > 2:
        mean = 2 * n1 * n0 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((high[1:] != high[:-1]).sum())
        p_runs = _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    x = at - at.mean()
    power = float((x * x).sum())
    p_serial = _two_sided(float((x[1:] * x[:-1]).sum()) / power * math.sqrt(n)) if power else 0.0
    return min(1.0, 3 * min(_upper_chi(chi, bins - 1), p_runs, p_serial))


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTH_CLASSES) - 1


def char_counts(docs: DataFrame) -> DataFrame:
    """(code, n): counts of neighbouring characters (128 * first + second) within words, over all texts."""

    def count(batches):
        total = np.zeros(128 * 128, np.int64)
        for _, texts in common.slices(batches):
            buf = np.frombuffer(b"\n".join(texts), np.uint8)
            a, b = buf[:-1], buf[1:]
            ok = (a > 32) & (a < 127) & (b > 32) & (b < 127)
            total += np.bincount(a[ok].astype(np.int32) * 128 + b[ok], minlength=128 * 128)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    return docs.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def text_model(docs: DataFrame) -> np.ndarray:
    """Counts of (character, next) over the corpus, 128 x 128; a table of fixed size."""
    counts = np.zeros(128 * 128)
    for code, n in char_counts(docs).collect():  # at most 128 * 128 rows
        counts[code] = n
    return counts.reshape(128, 128)


def text_likelihood(word: np.ndarray, counts: np.ndarray, rows: np.ndarray, single: np.ndarray, weight: float = 50.0) -> float:
    """log10 probability of a word's steps as ordinary text. Each step's own occurrence is left out of the counts, and
    scarce counts lean on the single characters' shares."""
    a, b = word[:-1], word[1:]
    return float(np.log10((np.maximum(counts[a, b] - 1, 0) + weight * single[b]) / (np.maximum(rows[a] - 1, 0) + weight)).sum())


class Examiner:
    """What a worker needs to examine one text: the text model as probabilities' parts."""

    def __init__(self, model: np.ndarray):
        self.model = model.astype(np.float32)
        self.rows = self.model.sum(axis=1)
        self.single = (self.model.sum(axis=0) + 0.5) / (self.model.sum() + 64)

    def examine(self, text: bytes) -> tuple[list, list, list]:
        """(base spans, words that may be random, tested): spans are (start, end, ...) in bytes.

        ``words`` hold (start, end, length class, evidence against text, evidence against randomness) in steps; ``tested``
        has length class * BATTERY_STEPS + evidence against randomness for every word.
        """
        base, words, tested = base_spans(text), [], []
        if b"h" * MIN_LENGTH in text.translate(_LONG_RUN):
            for m in WORD.finditer(text):
                for start, end, enc in tries(m.group()):
                    kind, n = length_class(end - start), len(enc[1])
                    p = battery(enc[1], enc[2]) if n >= 4 else 0.0
                    unlike = BATTERY_STEPS - 1 if p <= 0 else min(BATTERY_STEPS - 1, int(-4 * math.log10(p)))
                    tested.append(kind * BATTERY_STEPS + unlike)
                    if n < 4:
                        continue
                    a = np.frombuffer(m.group()[start:end], np.uint8)
                    gain = -n * math.log10(enc[2]) - text_likelihood(a, self.model, self.rows, self.single)
                    step = int(min(STEPS, 4 * gain))
                    if step >= 4:
                        words.append((m.start() + start, m.start() + end, kind, step, unlike))
        if base:
            words = [w for w in words if not any(s < w[1] and w[0] < e for s, e, _ in base)]
        return base, words, tested


def code_points(text: bytes, marks: list[int]) -> dict[int, int]:
    """Byte offsets (sorted) to code points."""
    if text.isascii():
        return {x: x for x in marks}
    points, last, count = {}, 0, 0
    for x in marks:
        count += len(text[last:x].decode("utf-8", "surrogatepass"))
        points[x], last = count, x
    return points


def scan(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """One row per document: base spans, words that may be random (code points), and the battery's step of each word."""
    spans = pa.list_(pa.list_(pa.int32()))

    def run(batches):
        examiner = Examiner(model)
        for batch, texts in common.slices(batches):
            base_out, words_out, tested_out = [], [], []
            for text in texts:
                base, words, tested = examiner.examine(text)
                points = code_points(text, sorted({x for s in base + words for x in s[:2]})) if base or words else {}
                base_out.append([[points[s], points[e], k] for s, e, k in base])
                words_out.append([[points[s], points[e], *more] for s, e, *more in words])
                tested_out.append(tested)
            yield common.with_columns(batch, ("doc_id",), base=pa.array(base_out, spans), tested=pa.array(tested_out, pa.list_(pa.int32())), words=pa.array(words_out, spans))

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base array<array<int>>, tested array<int>, words array<array<int>>")


def _step_up(above: np.ndarray, tested: float, rate: float) -> int:
    """The least step (a quarter decade of p-value each) whose discoveries keep to the rate; one past the end if none."""
    p = 10.0 ** (-np.arange(len(above)) / 4)
    ok = np.flatnonzero((above > 0) & (p * tested <= rate * above))
    return int(ok[0]) if len(ok) else len(above)


def thresholds(scanned: DataFrame, rate: float = FALSE_DISCOVERY, lost: float = RANDOM_LOST) -> list[tuple[int, int]]:
    """For each class of lengths (least evidence against text, least evidence against randomness that rejects it)."""
    tested = np.zeros((len(LENGTH_CLASSES), BATTERY_STEPS))
    for code, n in scanned.select(F.explode("tested").alias("code")).groupBy("code").count().collect():  # classes x steps rows at most
        tested[divmod(code, BATTERY_STEPS)] = n
    words = scanned.select(F.explode("words").alias("w")).groupBy(*(F.col("w")[k].alias(c) for k, c in ((2, "kind"), (3, "step"), (4, "unlike")))).count()
    seen = words.collect()  # at most length classes x steps x steps rows
    out = []
    for kind in range(len(LENGTH_CLASSES)):
        m = tested[kind].sum()
        reject = _step_up(np.cumsum(tested[kind][::-1])[::-1], m, lost)
        steps = np.zeros(STEPS + 1)
        for k, step, unlike, n in seen:
            if k == kind and unlike < reject:
                steps[step] += n
        out.append((_step_up(np.cumsum(steps[::-1])[::-1], m, rate), reject))
    return out


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """(doc_id, spans): spans are structs kind, start, end in code points, ordered by start, then kind."""
    scanned = common.cut(scan(docs, text_model(docs)))
    cuts = thresholds(scanned, rate)
    least, reject = (F.array(*(F.lit(c[k]) for c in cuts)) for k in (0, 1))
    kinds = F.array(*(F.lit(x) for x in KINDS))
    base = F.transform("base", lambda s: F.struct(s[0].alias("start"), s[2].alias("k"), s[1].alias("end")))
    random = F.filter("words", lambda w: (w[3] >= F.get(least, w[2])) & (w[4] < F.get(reject, w[2])))
    more = F.transform(random, lambda w: F.struct(w[0].alias("start"), F.lit(3).alias("k"), w[1].alias("end")))
    spans = F.transform(F.array_sort(F.concat(base, more)), lambda s: F.struct(F.get(kinds, s["k"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.select("doc_id", spans.alias("spans"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count("random").alias("n_random"),
    )


def redact(docs: DataFrame, mark: str = "<SECRET>", rate: float = FALSE_DISCOVERY) -> DataFrame:
    """The documents with every span that find_secrets() reports replaced by ``mark``; n_chars follows where it exists.

    Texts are examined twice, first for the thresholds, then to mask them where they stand: no text is shuffled or joined,
    so repeated and null ids and columns of any name keep their rows.
    """
    model = text_model(docs)
    cuts = thresholds(common.cut(scan(docs.select("doc_id", "text"), model)), rate)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 128 x 128 counts
    fill = mark.encode()

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        examiner = Examiner(shared.value)

        def one(t):
            if t is None:
                return None
            raw = t.encode("utf-8", "surrogatepass")
            base, words, _ = examiner.examine(raw)
            found = [(s, e) for s, e, _ in base] + [(s, e) for s, e, kind, step, unlike in words if step >= cuts[kind][0] and unlike < cuts[kind][1]]
            if not found:
                return None
            out, at = [], 0
            for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
                if e <= at:
                    continue
                if s >= at:
                    out += [raw[at:s], fill]
                at = max(at, e)
            return (b"".join(out) + raw[at:]).decode("utf-8", "surrogatepass")

        return pd.Series([one(t) for t in text], dtype=object)

    found = common.wrapped(docs, masked(common.field("text")).alias("masked"))
    changed = {"text": F.coalesce("masked", F.col("row")["text"])}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("masked").isNull(), F.col("row")["n_chars"]).otherwise(F.length("masked").cast(docs.schema["n_chars"].dataType))
    return common.unwrapped(found, docs.columns, **changed)


QUERIES = {"op1_secrets": op1_secrets}
ORACLE_SQL: dict[str, str] = {}
