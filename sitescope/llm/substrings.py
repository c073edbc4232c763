"""Operator 3: repeated passages, found in a compacted de Bruijn graph of words.

A window is WINDOW consecutive words. Its minimizer is its K-word run of least hash; consecutive windows of one
minimizer form a path of the graph, with the minimizer as node and the path's whole word sequence as edge label. Paths
are what travels, about one for five windows:

1. A chunk of documents sends each distinct (node, label) it holds once, with its least document (so a passage that a
   third of all documents share arrives once a chunk, not once a document).
2. A bucket of nodes tells the chunks, for labels seen elsewhere, the least document of all that holds the label, and
   whether the node branches (several labels, several documents). Where it does not branch, the path is settled whole:
   all its windows start in a smaller document exactly if its label does.
3. Only the first holders of labels at branching nodes expand their paths into windows: whoever also holds such a
   window has either a settled path or expands it, too. A chunk sends each window once, with its least document there,
   and is told which of them start in a smaller document elsewhere; the others it judges by itself.
4. The chunks put the answers to their source coordinates, mark the words covered and drop them.

Labels and windows are verified by a second digest, computed at the source coordinates from the words' bytes by another,
independent hash: only spans that agree in both (128 bits) count as equal.

A node that very many paths of the corpus pass, such as one at the border of boilerplate, would gather a label for each
document. Such hot nodes are known beforehand, by a fixed-size table of counts of the nodes' classes; their paths are all
expanded into windows, which combine before the shuffle, and no label of theirs is sent.

The chunks' texts are shuffled once; the steps reuse that exchange. Documents are dealt to chunks by id and text, so many
rows of one id (or none) spread.

Null and empty texts have no words; texts shorter than a window lose none. Documents with a null id neither lose words
nor count as earlier ones. Rows with equal ids are separate texts of which none is earlier; repeated rows lose the same
words. An empty table gives no rows. Very long texts are whole within one chunk, at about 100 bytes a word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitescope.llm import common

WINDOW = 13
K = 5
#: Nodes that one bucket holds on average at most.
BUCKET_NODES = 1_000_000
#: Paths of the corpus through a class of nodes that make it hot, and the number of classes (a power of two).
HOT_PATHS = 1_000_000
CLASS_BITS = 21
#: Bytes of text whose words a chunk looks at together (one text at least).
SLICE_BYTES = 400_000


def minimizers(sums: common.Spans, owner: np.ndarray, known: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least run, its place) of the window at each word, and which words start a window of a named document."""
    n = len(owner) - window + 1
    start = np.arange(len(owner) - k + 1)
    runs = sums.of(start, start + k)
    best, place = runs[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window - k + 1):
        less = runs[j : j + n] < best
        np.copyto(best, runs[j : j + n], where=less)
        place[less] = j
    return best, place, np.flatnonzero((owner[:n] == owner[window - 1 :]) & known[owner[:n]])


def _cut(texts: list[bytes]) -> list[int]:
    """Where slices of about SLICE_BYTES begin, and the end."""
    ends = np.cumsum([len(t) for t in texts])
    return [*np.flatnonzero(np.diff((ends - 1) // SLICE_BYTES, prepend=-1)).tolist(), len(texts)] if len(texts) else [0]


class Paths:
    """The paths of a chunk's documents. Words are looked at slice by slice: a chunk keeps of each word but its two hashes."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, known: np.ndarray, window: int, k: int, hot: np.ndarray | None = None):
        self.window = window
        self.n_words = np.zeros(len(texts), np.int64)
        #: Where each slice's words begin, and these words' hashes by both tables.
        self.begin, self.hashes = [0], []
        empty = np.zeros(0, np.int64)
        found = [(empty, empty, *[np.zeros(0, np.uint64)] * 3, empty)]
        cuts = _cut(texts)
        for lo, hi in zip(cuts, cuts[1:]):
            hashes, owner, digests = common.word_hashes(texts[lo:hi], tables=2)
            self.n_words[lo:hi] = np.bincount(owner, minlength=hi - lo)
            if len(hashes) >= window:
                sums = common.Spans(hashes)
                best, place, whole = minimizers(sums, owner, known[lo:hi], window, k)
                if len(whole):
                    at = whole + place[whole]
                    begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)])
                    first, last = whole[begin], whole[np.r_[begin[1:] - 1, len(whole) - 1]]
                    label, check = sums.of(first, last + window), common.Spans(digests).of(first, last + window)
                    found.append((self.begin[-1] + first, self.begin[-1] + last, best[first], label, check, ids[lo:hi][owner[first]]))
            self.hashes.append((hashes, digests))
            self.begin.append(self.begin[-1] + len(hashes))
        self.first, self.last, self.node, self.label, self.check, self.doc = (np.concatenate(x) for x in zip(*found))
        del found
        #: Paths at hot nodes: always looked at window by window.
        self.hot = hot[class_of(common.mix(self.node))] if hot is not None and len(hot) else np.zeros(len(self.node), bool)
        cold = np.flatnonzero(~self.hot)
        order = cold[np.lexsort((self.doc[cold], self.check[cold], self.label[cold], self.node[cold]))]
        node, label, check = self.node[order], self.label[order], self.check[order]
        head = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (label[1:] != label[:-1]) | (check[1:] != check[:-1])]) if len(order) else empty
        #: Distinct (node, label, digest) with the least document; ``entry`` leads from paths to them.
        self.nodes, self.labels, self.checks, self.least = node[head], label[head], check[head], self.doc[order][head]
        self.entry = np.zeros(len(self.node), np.int64)
        self.entry[order] = np.cumsum(np.r_[0, np.diff(np.searchsorted(head, np.arange(len(order)), side="right"))]) if len(order) else empty

    def answered(self, replies: pd.DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Per path: whether it goes, and whether it must be looked at window by window."""
        least, branch = self.least.copy(), np.zeros(len(self.least), bool)
        of = bucket_of(self.nodes, buckets)
        order = np.argsort(of, kind="stable")
        begin = np.searchsorted(of[order], np.arange(buckets + 1))
        for b, at, low, forks in zip(replies["bucket"], replies["at"], replies["least"], replies["branch"]):
            own = order[begin[b] : begin[b + 1]][np.frombuffer(at, np.int32)]
            least[own] = np.frombuffer(low, np.int64)
            branch[own] = np.frombuffer(forks, np.uint8) > 0
        if not len(least):
            return np.zeros(len(self.doc), bool), self.hot
        gone = (self.doc > least[self.entry]) & ~self.hot
        return gone, (~gone & branch[self.entry]) | self.hot

    def windows(self, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, hash, digest, document) of every window of the paths."""
        empty = np.zeros(0, np.uint64)
        found = [(np.zeros(0, np.int64), empty, empty)]
        cuts = np.searchsorted(self.first[paths], self.begin)
        for lo, hi, begin, (hashes, digests) in zip(cuts, cuts[1:], self.begin, self.hashes):
            if lo < hi:
                first, last = self.first[paths[lo:hi]] - begin, self.last[paths[lo:hi]] - begin
                n = last - first + 1
                start = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                end = start + self.window
                found.append((start + begin, common.Spans(hashes).of(start, end), common.Spans(digests).of(start, end)))
        start, value, digest = (np.concatenate(x) for x in zip(*found))
        return start, value, digest, np.repeat(self.doc[paths], self.last[paths] - self.first[paths] + 1)


def class_of(nodes: np.ndarray) -> np.ndarray:
    return (nodes >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def hot_classes(docs: DataFrame, window: int, k: int, least: int, fan: int = 256) -> np.ndarray:
    """Which classes of nodes more than ``least`` paths pass; empty if none. ``docs``: id, unnamed, text.

    Minimizers are small hashes, so classes are of the mixed hash. Tasks send their counts in blocks, which are added up in
    two steps; only blocks with a hot class come to the driver, as bits.
    """
    width = 1 << 12

    def count(batches):
        total = np.zeros(1 << CLASS_BITS, np.int64)
        for batch, texts in common.slices(batches):
            unnamed = batch.column("unnamed").to_numpy(zero_copy_only=False).astype(bool)
            hashes, owner = common.word_hashes(texts)
            if len(hashes) < window:
                continue
            best, place, whole = minimizers(common.Spans(hashes), owner, ~unnamed, window, k)
            at = whole + place[whole]
            first = whole[np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)])] if len(whole) else whole
            total += np.bincount(class_of(common.mix(best[first])), minlength=len(total))
        yield from common.count_blocks(total, width, TaskContext.get().partitionId() % fan)

    def bits(total: np.ndarray) -> bytes | None:
        return np.packbits(total > least).tobytes() if (total > least).any() else None

    added = common.added_up(docs.mapInArrow(count, "block int, part int, counts binary"), width, bits)
    hot = np.zeros(1 << CLASS_BITS, bool)
    for block, found in added.where("counts is not null").collect():
        hot[block * width : (block + 1) * width] = np.unpackbits(np.frombuffer(found, np.uint8))
    return hot if hot.any() else np.zeros(0, bool)


def new_windows(value: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Which of sorted windows differ from the one before."""
    return np.r_[True, (value[1:] != value[:-1]) | (digest[1:] != digest[:-1])] if len(value) else np.zeros(0, bool)


def bucket_of(nodes: np.ndarray, buckets: int) -> np.ndarray:
    return (common.mix(nodes) % np.uint64(buckets)).astype(np.int64)


NODES = "bucket int, chunk int, node binary, label binary, check binary, least binary"
REPLIES = "chunk int, bucket int, at binary, least binary, branch binary"


def settle_nodes(bucket: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answers to its chunks, for the entries whose fate is not that of a label seen once."""
    sizes = np.array([len(x) // 8 for x in bucket["node"]])
    node, label, check = (np.frombuffer(b"".join(bucket[c]), np.uint64) for c in ("node", "label", "check"))
    doc = np.frombuffer(b"".join(bucket["least"]), np.int64)
    row = np.repeat(np.arange(len(bucket)), sizes)
    at = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((doc, check, label, node))
    node, label, check, doc, row, at = node[order], label[order], check[order], doc[order], row[order], at[order]
    new_node = np.r_[True, node[1:] != node[:-1]]
    new_label = new_node | np.r_[True, (label[1:] != label[:-1]) | (check[1:] != check[:-1])]
    head, group = np.flatnonzero(new_label), np.cumsum(new_label) - 1
    least = doc[head][group]
    start, which = np.flatnonzero(new_node), np.cumsum(new_node) - 1
    several_labels = np.add.reduceat(new_label.astype(np.int64), start) > 1
    several_docs = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
    branch = (several_labels & several_docs)[which]
    tell = np.flatnonzero((least < doc) | branch)
    tell = tell[np.argsort(row[tell], kind="stable")]
    rows = []
    for part in np.split(tell, np.flatnonzero(np.diff(row[tell])) + 1) if len(tell) else []:
        rows.append((bucket["chunk"].iloc[row[part[0]]], bucket["bucket"].iloc[0], at[part].astype(np.int32).tobytes(), least[part].tobytes(), branch[part].astype(np.uint8).tobytes()))
    return pd.DataFrame(rows, columns=["chunk", "bucket", "at", "least", "branch"])


def drop_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, hot_paths: int = HOT_PATHS) -> DataFrame:
    """(row, doc_id, n_words, n_removed, kept, kept_sha256): ``row`` is the document as it came, ``kept`` the words left,
    joined by one space, where any was removed (else null), and the digest that of the kept words in either case."""
    total = docs.agg(F.sum(F.octet_length(common.field("text")))).first()[0] or 0
    n = common.parts(docs)
    chunks = max(n, -(-total // common.CHUNK_BYTES))
    buckets = int(max(2 * n, -(-total // (30 * BUCKET_NODES))))  # about 30 bytes a path
    # the id travels as a plain long, and whether it is null apart from it; the other columns travel as they are
    ident, text = common.field("doc_id").cast("long"), common.field("text")
    rest = [common.field(c).alias(c) for c in docs.columns if c != "text"]
    dealt = docs.select(F.struct(*rest).alias("row"), F.coalesce(ident, F.lit(0)).alias("id"), ident.isNull().alias("unnamed"), text.alias("text"))
    # fewer bytes than so many paths have no hot node
    hot = hot_classes(dealt.select("id", "unnamed", "text"), window, k, hot_paths) if total > 2 * hot_paths else np.zeros(0, bool)
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # 2**CLASS_BITS bytes at most
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id", "unnamed", "text"), F.lit(chunks)).cast("int")).repartition(n, "chunk")

    def paths(docs: pa.Table) -> Paths:
        ids, unnamed = (docs.column(c).to_numpy() for c in ("id", "unnamed"))
        return Paths(common.utf8(docs.column("text")), ids, ~unnamed.astype(bool), window, k, shared.value)

    def table(schema: str, columns: list) -> pa.Table:
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        named = [c.split() for c in schema.split(", ")]
        return pa.table([pa.array(x, kinds[kind]) for x, (_, kind) in zip(columns, named)], [c for c, _ in named])

    def send(key: tuple, docs: pa.Table) -> pa.Table:
        own = paths(docs)
        of = bucket_of(own.nodes, buckets)
        order = np.argsort(of, kind="stable")
        rows = []
        for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
            rows.append((int(of[part[0]]), key[0].as_py(), *(x[part].tobytes() for x in (own.nodes, own.labels, own.checks, own.least))))
        return table(NODES, list(zip(*rows)) or [[]] * 6)

    WINDOWS = "window long, digest long, doc long, chunk int"

    def expand(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows or not (replies.num_rows or len(shared.value)):
            return table(WINDOWS, [[]] * 4)
        own = paths(docs)
        _, look = own.answered(replies.to_pandas(), buckets)
        _, value, digest, doc = own.windows(np.flatnonzero(look))
        order = np.lexsort((doc, digest, value))
        first = order[new_windows(value[order], digest[order])]
        return table(WINDOWS, [value[first].view(np.int64), digest[first].view(np.int64), doc[first], np.full(len(first), key[0].as_py(), np.int32)])

    def finish(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = common.utf8(docs.column("text"))
        own = paths(docs)
        cover = np.zeros(own.begin[-1] + 1, np.int32)
        if answers.num_rows:
            answers = answers.to_pandas()
            is_reply = answers["bucket"] >= 0
            gone, look = own.answered(answers[is_reply], buckets)
            np.add.at(cover, own.first[gone], 1)
            np.add.at(cover, own.last[gone] + window, -1)
            chosen = np.flatnonzero(look)
            if len(chosen):
                start, value, digest, doc = own.windows(chosen)
                order = np.lexsort((doc, digest, value))
                head = new_windows(value[order], digest[order])
                group = np.cumsum(head) - 1
                first = order[head]
                pair = lambda v, g: common.mix(v) + g
                there = pair(*(answers[c][~is_reply].to_numpy().view(np.uint64) for c in ("window", "digest")))
                elsewhere = np.isin(pair(value[first], digest[first]), there)
                hit = start[order[elsewhere[group] | (doc[order] > doc[first][group])]]
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + window, -1)
        covered = np.cumsum(cover[:-1], dtype=np.int32) > 0
        n_words = own.n_words
        first = np.cumsum(n_words) - n_words
        upto = np.r_[0, np.cumsum(covered)]
        n_removed = upto[first + n_words] - upto[first]
        kept, digests = [], []
        for i, text in enumerate(texts):
            words = text.split()
            if n_removed[i]:
                words = [w for w, c in zip(words, covered[first[i] : first[i] + n_words[i]].tolist()) if not c]
            joined = b" ".join(words)
            kept.append(joined.decode("utf-8", "surrogatepass") if n_removed[i] else None)
            digests.append(hashlib.sha256(joined).hexdigest())
        out = docs.select(["row", "unnamed", "text"])
        for name, x in (("n_words", pa.array(n_words)), ("n_removed", pa.array(n_removed)), ("kept", pa.array(kept, pa.string())), ("kept_sha256", pa.array(digests, pa.string()))):
            out = out.append_column(name, x)
        return out

    nodes = dealt.groupBy("chunk").applyInArrow(send, NODES)
    replies = nodes.groupBy("bucket").applyInPandas(settle_nodes, REPLIES)
    expanded = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(expand, WINDOWS)
    same = ["window", "digest"]
    repeated = expanded.withColumn("first", F.min("doc").over(Window.partitionBy(*same))).where("doc > first").select("chunk", *same)
    # no nulls among the longs: pandas would turn them into floats
    none, zero = F.lit(b""), F.lit(0).cast("long")
    answers = replies.select("chunk", "bucket", "at", "least", "branch", zero.alias("window"), zero.alias("digest")).unionByName(
        repeated.select("chunk", F.lit(-1).alias("bucket"), none.alias("at"), none.alias("least"), none.alias("branch"), *same)
    )
    schema = StructType().add("row", dealt.schema["row"].dataType)
    for name, kind in (("unnamed", "boolean"), ("text", "string"), ("n_words", "long"), ("n_removed", "long"), ("kept", "string"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
    whole = [(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return out.select(F.struct(*whole).alias("row"), F.col("row").getField("doc_id").alias("doc_id"), "n_words", "n_removed", "kept", "kept_sha256")


def without_repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The documents with their repeated passages dropped; texts that lose none stay as they are. n_chars follows where it
    exists."""
    out = drop_repeats(docs, window, k)
    changed = {"text": F.coalesce("kept", F.col("row")["text"])}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("kept").isNull(), F.col("row")["n_chars"]).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType))
    return common.unwrapped(out, docs.columns, **changed)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op3_substrings": op3_substrings}
ORACLE_SQL = {
    "op3_substrings": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d) x
), firsts AS (
  SELECT g, min(doc_id) AS first_id FROM win GROUP BY g
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (g) WHERE first_id < doc_id) y GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, w, coalesce(gone, []) AS gone, map_from_entries(list_transform(coalesce(gone, []), lambda p: {'k': p, 'v': true})) AS is_gone FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: is_gone[i] IS NULL), lambda i: w[i]), ' ')) AS kept_sha256 FROM kept"""
}
