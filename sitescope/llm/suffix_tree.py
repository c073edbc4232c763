"""Operator 8: scores by a probabilistic suffix tree over words.

A state of the tree is a context of up to DEPTH words that training holds twice or more. The root predicts by the base
formula. A context predicts a successor by its own count, smoothed with the prediction of its longest kept suffix (its
parent): successors seen once give their mass to the parent, as a measure of what is yet unseen, together with PRIOR:

    p = (count + (ones + PRIOR) * parent) / (total + PRIOR),   count = 0 for successors seen once

where total counts all occurrences of the context, so that the probabilities of a context add up to 1. A context is kept
if it diverges from its parent: the log-likelihood ratio of its occurrences (its total times the divergence from the
parent) must exceed GAIN nats for each successor it stores. A token is predicted by the longest kept suffix of what
stands before it; the suffix may be of any length up to DEPTH, or empty.

The tree is never gathered in one place. Chunks of documents send, level by level, the contexts and successors they
hold; buckets of contexts add the counts up and send back to each chunk the statistics of what it asked for. A run of
words occurs twice only if its beginning and its end do, so only such runs are asked for. Of contexts with HOT or more
occurrences the successors are dealt over several buckets, and a chunk asks only for the parts it holds. Each part counts
its successors by their count and their parent's step; from these tallies, added up, such a context gets the same test and
weight as any other, so results do not depend on where dealing begins. (Callers may give these contexts a fixed weight
instead, HOT_WEIGHT, without the test; the registered query does not.) A chunk's words are hashed once and travel as numbers in one compressed
row, shuffled once; all levels reuse that exchange, and each level's answers are shuffled once.

Null and empty texts hold the end token alone. Documents with a null id count as training documents. Repeated rows and
rows of one id count as often as they stand there. An empty table gives no rows. A very long text makes a chunk of its
own, at about 150 bytes a word. Words and contexts are told apart by 64-bit hashes; the successors of a context by the
words' numbers, which the buckets of words give out, each number once: so no two words merge, and the probabilities of a
context add up to 1. Equal scores are ties of equal texts or of chance; nothing depends on their order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.llm import common
from sitescope.llm.common import pack, unpack

DEPTH = 3
#: Occurrences that make a context; fewer cannot repeat a successor.
MIN_CONTEXT = 2
PRIOR = 2.0
GAIN = 3.0
HOT = 16_000_000
HOT_WEIGHT = 1 / 32
CHUNK_BYTES = 11_000_000
#: Entries that one bucket of words or contexts holds on average at most.
BUCKET_ENTRIES = 2_000_000
#: Parents' log-probabilities travel in steps of 1/STEP nat; they serve the test only.
STEP = 12
#: Bits of a word's number; more words than that have no numbers.
NUMBER_BITS = 40
_END = np.uint64(0x5DEECE66D1234567)
_PART = np.uint64(0x9E3779B97F4A7C15)

REQUEST = "bucket int, chunk long, keys binary, sizes binary, rest binary, next binary, count binary, parent binary, whole binary"
REPLY = "chunk long, level int, bucket int, kept binary, stored binary, counts binary"
#: The bucket of replies about whole contexts whose successors are dealt; their tallies travel under negative chunks.
WHOLE = -1
TALLY = "key long, level int, total long, chunks binary, tally binary, times binary"


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def pack_runs(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values that ascend within runs of these sizes: each but the first of its run as the step from the one before."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[first] = values[first]
    return pack(steps)


def unpack_runs(data: bytes, sizes: np.ndarray) -> np.ndarray:
    upto = np.cumsum(unpack(data, np.uint64), dtype=np.uint64)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return upto - np.where(first > 0, upto[first - 1], np.uint64(0))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the keys, so that sorted keys lie bucket by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(of: np.ndarray):
    """(bucket, slice) of sorted bucket numbers."""
    begin = _runs(of)
    for lo, hi in zip(begin, np.r_[begin[1:], len(of)]):
        yield int(of[lo]), slice(int(lo), int(hi))


def _frame(rows: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    named = [c.split() for c in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(named)], [c for c, _ in named])


def _by_frequency(times: np.ndarray) -> np.ndarray:
    """Words (by number) in order of how often a chunk holds them: frequent ones have small ranks, which compress well."""
    return np.argsort(-times, kind="stable")


class Tokens:
    """A chunk's tokens, and what its levels have been told."""

    def __init__(self, chunk: dict, buckets: int, base: float, hot_size: int, weighted: bool = False):
        self.words = unpack_sorted(chunk["words"])
        self.word = _by_frequency(unpack(chunk["times"], np.int64)).astype(np.int32)[unpack(chunk["tokens"], np.uint32)]
        self.n = np.array(chunk["sizes"], np.int64)
        m = len(self.n)
        self.owner = np.repeat(np.arange(m, dtype=np.int32), self.n)
        self.place = np.arange(len(self.word), dtype=np.int32) - np.repeat((np.cumsum(self.n) - self.n).astype(np.int32), self.n)
        self.train = ~np.array(chunk["held_out"], bool)[self.owner]
        self.sums = common.Spans(self.words[self.word])
        self.buckets, self.base, self.hot_size, self.weighted = buckets, base, hot_size, weighted
        self.gram = self.word

    # -- level 0: words ------------------------------------------------------------------------------------------------
    def word_requests(self, chunk: int) -> list:
        count = np.bincount(self.word, weights=self.train, minlength=len(self.words)).astype(np.int64)
        return [(b, chunk, pack_sorted(self.words[own]), b"", b"", b"", pack(count[own]), b"", b"") for b, own in _by_bucket(bucket_of(self.words, self.buckets))]

    def told_words(self, replies: dict) -> None:
        seen = np.zeros(len(self.words), np.int64)
        #: The words' numbers: a bucket's ranks by frequency, dealt in turn, so that frequent words have small ones.
        self.number = np.zeros(len(self.words), np.uint64)
        for b, own in _by_bucket(bucket_of(self.words, self.buckets)):
            seen[own] = unpack(replies[b][2], np.int64)
            self.number[own] = unpack(replies[b][1], np.uint64) * np.uint64(self.buckets) + np.uint64(b)
        #: Words in order of their numbers, as pairs stand within their context, and each word's place there.
        self.by_number = np.argsort(self.number, kind="stable")
        self.place_of = np.empty(len(self.words), np.int64)
        self.place_of[self.by_number] = np.arange(len(self.words))
        #: Training count of the run that ends at each place (0 where it was not asked for), and the run's number here.
        self.count = self.seen = seen[self.word]
        self.p = (self.seen + 1) / self.base

    # -- level d: contexts of d words ----------------------------------------------------------------------------------
    def contexts(self, depth: int) -> None:
        """The contexts of this level and their pairs with successors, in the order both sides use."""
        before = np.r_[0, self.count[:-1]]
        at = np.flatnonzero((self.place >= depth) & (before >= MIN_CONTEXT))
        self.at, self.total = at, before[at]
        unit = self.gram[at - 1].astype(np.int64)
        self.hot = self.total >= self.hot_size
        if self.hot.any():
            parts = np.where(self.hot, 2 + self.total // self.hot_size, 1)
            part = np.where(self.hot, (common.mix(self.words[self.word[at]]) >> np.uint64(33)).astype(np.int64) % parts, 0)
            numbers, unit = np.unique(unit * (int(parts.max()) + 1) + part, return_inverse=True)
            n, part_of = len(numbers), numbers % (int(parts.max()) + 1)
        else:
            there = np.zeros(int(unit.max(initial=-1)) + 1, bool)
            there[unit] = True
            unit = (np.cumsum(there) - 1)[unit]
            n, part_of = int(there.sum()), np.int64(0)
        first = np.zeros(n, np.int64)
        first[unit[::-1]] = np.arange(len(at))[::-1]
        whole = self.sums.of(at[first] - depth, at[first])
        key = common.mix(whole + np.asarray(part_of).astype(np.uint64) * _PART)
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.unit, self.keys, self.hot_unit = rank[unit], key[order], self.hot[first][order]
        self.whole, self.unit_total = whole[order], self.total[first][order]
        # successors whose run without the context's first word repeats, too
        self.asked = np.flatnonzero(self.count[at] >= 2)
        pair = self.unit[self.asked] * len(self.words) + self.place_of[self.word[at[self.asked]]]
        pairs, where, self.pair_of = np.unique(pair, return_index=True, return_inverse=True)
        where = self.asked[where]
        self.pair_at, self.pair_unit, self.pair_word = at[where], pairs // len(self.words), self.by_number[pairs % len(self.words)]
        self.pair_count = np.bincount(self.pair_of, weights=self.train[at[self.asked]], minlength=len(pairs)).astype(np.int64)
        self.sizes = np.bincount(self.pair_unit, minlength=n)

    def context_requests(self, chunk: int) -> list:
        succ = self.number[self.pair_word]
        if len(succ) and int(succ.max()) >> NUMBER_BITS:
            raise OverflowError(f"a word's number takes more than {NUMBER_BITS} bits")
        parent = np.clip(np.rint(-STEP * np.log(self.p[self.pair_at])), 0, 255).astype(np.uint8)
        ends = np.cumsum(self.sizes)
        # occurrences here with other successors: with the pairs' counts, all chunks' make up the total. Hot parts: the
        # whole context's total, negative
        inside = np.bincount(self.pair_unit, weights=self.pair_count, minlength=len(self.keys))
        rest = (np.bincount(self.unit, weights=self.train[self.at], minlength=len(self.keys)) - inside).astype(np.int64)
        rest[self.hot_unit] = -self.unit_total[self.hot_unit]
        rows = []
        for b, own in _by_bucket(bucket_of(self.keys, self.buckets)):
            pairs = slice(int(ends[own.start] - self.sizes[own.start]), int(ends[own.stop - 1]))
            rows.append((b, chunk, pack_sorted(self.keys[own]), pack(self.sizes[own]), pack(rest[own]), pack_runs(succ[pairs], self.sizes[own]), pack(self.pair_count[pairs]), pack(parent[pairs]), pack(self.whole[own][self.hot_unit[own]])))
        return rows

    def told_contexts(self, replies: dict) -> None:
        """Predict by the kept contexts of this level."""
        kept, stored = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), np.int64)
        count = np.zeros(len(self.pair_at), np.int64)
        ends = np.cumsum(self.sizes)
        for b, own in _by_bucket(bucket_of(self.keys, self.buckets)):
            k, s, c = replies[b]
            kept[own] = unpack(k, np.uint8) > 0
            stored[np.flatnonzero(kept[own]) + own.start] = unpack(s, np.int64)
            count[int(ends[own.start] - self.sizes[own.start]) : int(ends[own.stop - 1])] = unpack(c, np.int64)
        for k, s, _ in replies.get(WHOLE, ()):
            own = self.hot_unit & (self.whole == unpack(k, np.uint64)[0])
            kept[own], stored[own] = True, unpack(s, np.int64)[0]
        now = np.zeros(len(self.count), np.int64)
        now[self.at[self.asked]] = count[self.pair_of]
        gram = np.zeros(len(self.count), np.int32)
        gram[self.at[self.asked]] = self.pair_of
        use = np.flatnonzero(kept[self.unit])
        at, total = self.at[use], self.total[use]
        self.p[at] = smoothed(now[at], total, stored[self.unit[use]], self.p[at], self.hot[use] & self.weighted)
        self.count, self.gram = now, gram


def smoothed(count, total, stored, parent, hot=False):
    """The prediction of a context; ``stored``: the sum of its successors' counts, of those seen twice or more."""
    lean = np.where(hot, total * HOT_WEIGHT, np.maximum(total - stored, 0) + PRIOR)
    return (count + lean * parent) / np.where(hot, total + lean, np.maximum(total, stored) + PRIOR)


def add_words(bucket: pd.DataFrame) -> pd.DataFrame:
    """Training counts of a bucket's words and their ranks by these, to each chunk in its own order."""
    keys = [unpack_sorted(x) for x in bucket["keys"]]
    words, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, where, np.concatenate([unpack(x, np.int64) for x in bucket["count"]]))
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    rank = np.empty(len(words), np.uint64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(words), dtype=np.uint64)
    rows = [(c, 0, b, b"", pack(rank[own]), pack(total[own])) for c, b, own in zip(bucket["chunk"], bucket["bucket"], np.split(where, cuts))]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in REPLY.split(", ")])


def add_contexts(level: int, weighted: bool = False):
    def add(bucket: pd.DataFrame) -> pd.DataFrame:
        """Counts and test of a bucket's contexts, to each chunk in its own order."""
        keys = [unpack_sorted(x) for x in bucket["keys"]]
        n_keys = np.array([len(k) for k in keys])
        known, where = np.unique(np.concatenate(keys), return_inverse=True)
        sizes = [unpack(x, np.int64) for x in bucket["sizes"]]
        n_pairs = np.array([int(s.sum()) for s in sizes])
        joined = lambda c, kind: np.concatenate([unpack(x, kind) for x in bucket[c]])
        own = np.repeat(where, np.concatenate(sizes))
        each = joined("count", np.int64)
        rest = joined("rest", np.int64)
        hot = np.zeros(len(known), bool)
        hot[where[rest < 0]] = True
        total = (np.bincount(own, weights=each, minlength=len(known)) + np.bincount(where, weights=np.maximum(rest, 0), minlength=len(known))).astype(np.int64)
        pair = (own.astype(np.uint64) << np.uint64(NUMBER_BITS)) | np.concatenate([unpack_runs(x, n) for x, n in zip(bucket["next"], sizes)])
        order = np.argsort(pair)
        head = _runs(pair[order])
        count = np.add.reduceat(each[order], head) if len(head) else np.zeros(0, np.int64)
        count[count < 2] = 0
        of = own[order][head]
        step = joined("parent", np.uint8)[order][head]
        parent = np.exp(step / -STEP)
        several = count > 0
        stored = np.bincount(of, weights=count, minlength=len(known)).astype(np.int64)
        kinds = np.bincount(of, weights=several, minlength=len(known))
        kept = diverges(of, count, parent, np.where(hot, stored, total), stored, kinds)
        kept = hot | kept if weighted else ~hot & kept
        back = np.empty(len(order), np.int64)
        back[order] = np.repeat(count, np.diff(np.r_[head, len(order)]))
        rows = []
        key_cut, pair_cut = np.split(where, np.cumsum(n_keys)[:-1]), np.split(back, np.cumsum(n_pairs)[:-1])
        for c, b, k, x in zip(bucket["chunk"], bucket["bucket"], key_cut, pair_cut):
            rows.append((c, level, b, pack(kept[k].astype(np.uint8)), pack(stored[k][kept[k]]), pack(x)))
        if hot.any() and not weighted:
            asking = np.repeat(bucket["chunk"].to_numpy(), n_keys)
            whole, size = np.zeros(len(known), np.uint64), np.zeros(len(known), np.int64)
            whole[where[rest < 0]], size[where[rest < 0]] = joined("whole", np.uint64), -rest[rest < 0]
            for u in np.flatnonzero(hot):
                own = several & (of == u)
                tally, times = np.unique(count[own] << 8 | step[own], return_counts=True)
                about = [whole[u : u + 1].view(np.int64), size[u : u + 1], np.unique(asking[where == u])]
                rows.append((-1 - int(whole[u] >> np.uint64(2)), level, WHOLE, pack(np.concatenate(about)), pack(tally), pack(times)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in REPLY.split(", ")])

    return add


def tallies(batches):
    """The tallies among replies, as rows of TALLY."""
    for batch in batches:
        rows = batch.filter(pa.compute.less(batch.column("chunk"), 0)).to_pylist()
        about = [unpack(r["kept"], np.int64) for r in rows]
        columns = [[int(a[0]) for a in about], [r["level"] for r in rows], [int(a[1]) for a in about], [pack(a[2:]) for a in about], [r["stored"] for r in rows], [r["counts"] for r in rows]]
        yield from _frame(list(zip(*columns)), TALLY).to_batches()


def settle_whole(parts: pd.DataFrame) -> pd.DataFrame:
    """Count and test of one context whose successors were dealt, to each chunk that asked for any part, if it is kept."""
    tally, where = np.unique(np.concatenate([unpack(x, np.int64) for x in parts["tally"]]), return_inverse=True)
    times = np.bincount(where, weights=np.concatenate([unpack(x, np.int64) for x in parts["times"]]), minlength=len(tally)).astype(np.int64)
    count, parent = tally >> 8, np.exp((tally & 255) / -STEP)
    total, stored, kinds = (np.array([x]) for x in (int(parts["total"].iloc[0]), int((count * times).sum()), int(times.sum())))
    kept = diverges(np.zeros(len(count), np.int64), count, parent, total, stored, kinds, times)[0]
    key, level = pack(parts["key"].to_numpy()[:1]), parts["level"].iloc[0]
    chunks = np.unique(np.concatenate([unpack(x, np.int64) for x in parts["chunks"]])) if kept else []
    return pd.DataFrame([(c, level, WHOLE, key, pack(stored), b"") for c in chunks], columns=[c.split()[0] for c in REPLY.split(", ")])


def diverges(of: np.ndarray, count: np.ndarray, parent: np.ndarray, total: np.ndarray, stored: np.ndarray, kinds: np.ndarray, times=1) -> np.ndarray:
    """Whether contexts differ enough from their parents: ``of``, ``count`` and ``parent`` per successor (``times``: how
    many are alike), the rest per context."""
    gain = times * np.where(count > 0, count * np.log(smoothed(count, total[of], stored[of], parent) / parent), 0)
    ones = np.maximum(total - stored, 0)
    alone = ones * np.log((ones + PRIOR) / (np.maximum(total, stored) + PRIOR))
    return (kinds > 0) & (np.bincount(of, weights=gain, minlength=len(total)) + alone > GAIN * kinds)


def vocabulary(docs: DataFrame, buckets: int) -> tuple[int, int]:
    """(N, V): tokens and distinct tokens of the training documents. Tasks send their distinct hashes by bucket."""

    def count(batches):
        n, found = 0, np.zeros(0, np.uint64)
        fresh: list[np.ndarray] = []
        for _, texts in common.slices(batches):
            hashes, _ = common.word_hashes([t.translate(common.ASCII_LOWER) for t in texts])
            n += len(hashes) + len(texts)
            fresh.append(np.unique(hashes))
            if sum(map(len, fresh)) > 1_000_000:
                found, fresh = np.unique(np.concatenate([found, *fresh])), []
        found = np.unique(np.concatenate([found, *fresh, np.array([_END] if n else [], np.uint64)]))
        for b, own in _by_bucket(bucket_of(found, buckets)):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([n], pa.int64()), pa.array([pack_sorted(found[own])], pa.binary())], ["bucket", "n", "words"])
            n = 0

    def distinct(bucket: pd.DataFrame) -> pd.DataFrame:
        words = np.unique(np.concatenate([unpack_sorted(x) for x in bucket["words"]]))
        return pd.DataFrame({"n": [bucket["n"].sum()], "v": [len(words)]})

    sent = docs.where(~F.col("held_out")).select("text").mapInArrow(count, "bucket int, n long, words binary")
    row = sent.groupBy("bucket").applyInPandas(distinct, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return int(row[0] or 0), int(row[1] or 0)


CHUNK = "chunk long, id array<long>, unnamed array<boolean>, held_out array<boolean>, sizes array<int>, words binary, times binary, tokens binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def in_chunks(docs: DataFrame) -> DataFrame:
    """One row of CHUNK for documents that follow each other in a partition, about CHUNK_BYTES of text each: the distinct
    words' hashes, how often each occurs, and the tokens as ranks by frequency; ``sizes`` count the end tokens, too."""

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def made():
            hashes, owner = common.word_hashes([t.translate(common.ASCII_LOWER) for *_, t in held])
            n = np.bincount(owner, minlength=len(held)) + 1
            token = np.full(len(hashes) + len(held), _END)
            token[np.arange(len(hashes)) + owner] = hashes
            words, word, times = np.unique(token, return_inverse=True, return_counts=True)
            rank = np.empty(len(words), np.uint32)
            rank[_by_frequency(times)] = np.arange(len(words), dtype=np.uint32)
            lists = [pa.array([list(x)], pa.list_(kind)) for x, kind in zip(zip(*(row[:3] for row in held)), (pa.int64(), pa.bool_(), pa.bool_()))]
            lists += [pa.array([n], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in (pack_sorted(words), pack(times), pack(rank[word])))]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], [c.split()[0] for c in CHUNK.split(", ")])

        for batch, texts in common.slices(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "unnamed", "held_out")), texts):
                held.append(row)
                size += len(row[3])
                if size >= CHUNK_BYTES:
                    yield made()
                    number, held, size = number + 1, [], 0
        if held:
            yield made()

    return docs.select("id", "unnamed", "held_out", "text").mapInArrow(run, CHUNK)


def score_documents(docs: DataFrame, held_out, depth: int = DEPTH, hot: int | None = None, deal: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); ``held_out``: a boolean column. ``deal``:
    occurrences from which a context's successors are dealt, which changes no result; ``hot``: those from which contexts
    are to have a fixed weight, if any."""
    weighted = hot is not None
    deal = hot if weighted else deal
    total = docs.agg(F.sum(F.octet_length(common.field("text")))).first()[0] or 0
    n = common.parts(docs)
    buckets = int(max(2 * n, -(-total // (8 * BUCKET_ENTRIES))))
    ident = common.field("doc_id").cast("long")
    own = docs.select(F.coalesce(ident, F.lit(0)).alias("id"), ident.isNull().alias("unnamed"), common.field("text").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    n_train, n_words = vocabulary(own, buckets)
    base = float(n_train + n_words + 1)
    dealt = in_chunks(own).repartition(n, "chunk")

    def told(docs: pa.Table, replies: pa.Table | None, levels: int) -> tuple[Tokens, dict]:
        chunk = docs.to_pylist()[0]
        tokens = Tokens(chunk, buckets, base, deal, weighted)
        if replies is not None:
            by: dict = {level: {} for level in range(levels + 1)}
            for level, bucket, *row in zip(*(replies.column(c).to_pylist() for c in ("level", "bucket", "kept", "stored", "counts"))):
                if bucket == WHOLE:
                    by[level].setdefault(WHOLE, []).append(row)
                else:
                    by[level][bucket] = row
            tokens.told_words(by[0])
            for level in range(1, levels + 1):
                tokens.contexts(level)
                tokens.told_contexts(by[level])
        return tokens, chunk

    def ask_words(key: tuple, docs: pa.Table) -> pa.Table:
        return _frame(told(docs, None, 0)[0].word_requests(key[0].as_py()), REQUEST)

    def ask_contexts(level: int):
        def ask(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
            if not docs.num_rows:  # tallies
                return _frame([], REQUEST)
            tokens, _ = told(docs, replies, level - 1)
            tokens.contexts(level)
            return _frame(tokens.context_requests(key[0].as_py()), REQUEST)

        return ask

    def score(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:  # tallies
            return pa.table({c.split()[0]: pa.array([], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]]) for c in SCORES.split(", ")})
        tokens, chunk = told(docs, replies, depth)
        m = len(chunk["id"])
        summed = lambda x: np.bincount(tokens.owner, weights=x, minlength=m)
        columns = {
            "doc_id": pa.array([None if u else i for i, u in zip(chunk["id"], chunk["unnamed"])], pa.int64()), "held_out": pa.array(chunk["held_out"], pa.bool_()),
            "n_tokens": tokens.n, "n_known": summed(tokens.seen > 0).astype(np.int64), "base_score": summed(np.log10((tokens.seen + 1) / base)), "score": summed(np.log10(tokens.p)),
        }
        return pa.table(columns)

    # answers are dealt by chunk level by level: their union keeps that partitioning, and each exchange is reused
    replies = dealt.groupBy("chunk").applyInArrow(ask_words, REQUEST).groupBy("bucket").applyInPandas(add_words, REPLY).repartition(n, "chunk")
    for level in range(1, depth + 1):
        asked = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(ask_contexts(level), REQUEST)
        told_now = asked.groupBy("bucket").applyInPandas(add_contexts(level, weighted), REPLY).repartition(n, "chunk")
        replies = replies.union(told_now)
        if n_train >= deal and not weighted:  # fewer tokens have no such context
            replies = replies.union(told_now.mapInArrow(tallies, TALLY).groupBy("key").applyInPandas(settle_whole, REPLY).repartition(n, "chunk"))
    out = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2
    return score_documents(common.read(spark, sf_dir, "documents"), held_out)


QUERIES = {"op8_suffix_tree": op8_suffix_tree}
ORACLE_SQL: dict[str, str] = {}
