"""Operator 6: SimHash fingerprints and all pairs of them within a Hamming radius.

A text's terms are its runs of a number of words (shorter texts: the whole run), weighted by 1 + log(count), rounded; each
term's hash votes on signed bits. PARTS names the runs and their bits: single words vote on the head, which near copies
share almost whole; runs of three words vote on the rest, which unrelated texts do not share. Equal texts have equal
fingerprints. Empty and null texts have the fingerprint of no votes (all zero bits).

Search: two fingerprints are near if they differ in at most RADIUS bits of the head and WHOLE_RADIUS bits in all. The
head's bits are cut into blocks, more of them the more fingerprints there are. Near heads agree in at least RADIUS fewer
whole blocks, so each choice of that many blocks is a table (the bits permuted so that these lead), and fingerprints meet
where a table's leading bits are equal; leading bits grow with the fingerprints' number, so places stay small. Only distinct
fingerprints meet. Within a place a spanning forest of the near ones is returned, never all pairs. A place of more than
CROWDED is divided by the bits that its table leaves out: of RADIUS + 1 pieces of these one at least must be equal, too;
what is still crowded is divided again by the bits left then.

Order of documents for the edited texts: descending doc_id, ties by the text's SHA-256, null ids last; after the last
comes the first. A table of one document is followed by itself, an empty table gives no rows. Repeated rows follow each
other. Very long texts are whole within one worker, at about 300 bytes a word.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.llm import common

#: (words in a term, bits it votes on); the first part is the head.
PARTS = ((1, 64), (3, 128))
BITS = sum(bits for _, bits in PARTS)
HEAD = PARTS[0][1]
#: Bits that near fingerprints may differ in: of the head, and in all. The README states the measured recall.
RADIUS = 7
WHOLE_RADIUS = 40
#: A meeting place with more fingerprints than this is divided, and what is still crowded again, so often. Each division finds
#: the links of a cluster of copies several times over, so one is enough while blocks grow with the prints.
CROWDED = 1_000
DIVISIONS = 1
#: What a row of a table costs, in comparisons of fingerprints.
ROW = 100
#: Votes are added up in bytes, so many terms at a time.
_STEP = 255
_TEXT_BITS = 16


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """(len(texts), BITS // 8) bytes, for up to 2**_TEXT_BITS texts."""
    hashes, owner = common.word_hashes(texts)
    return np.concatenate([_votes(hashes, owner, len(texts), term, bits) for term, bits in PARTS], axis=1)


def _votes(hashes: np.ndarray, owner: np.ndarray, n: int, term: int, bits: int) -> np.ndarray:
    n_words = np.bincount(owner, minlength=n)
    at, value = common.grams(hashes, owner, term)
    of = owner[at]
    short = np.flatnonzero((n_words > 0) & (n_words < term))
    if len(short):
        spans, first = common.Spans(hashes), np.cumsum(n_words) - n_words
        value = np.concatenate([value, spans.of(first[short], first[short] + n_words[short])])
        of = np.concatenate([of, short])
    if not len(value):
        return np.zeros((n, bits // 8), np.uint8)
    # text in the upper bits, the term's hash in the lower ones: one sort brings a text's equal terms together
    low = np.uint64(64 - _TEXT_BITS)
    key = np.sort((of.astype(np.uint64) << low) | (value >> (np.uint64(64) - low)))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    weight = np.rint(1 + np.log(np.diff(np.r_[new, len(key)]))).astype(np.int64)
    key = np.repeat(key[new], weight)
    of = (key >> low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    size = np.diff(np.r_[first, len(key)])
    steps = -(-size // _STEP)
    start = np.repeat(first - (np.cumsum(steps) - steps) * _STEP, steps) + np.arange(steps.sum()) * _STEP
    base = key & ((np.uint64(1) << low) - np.uint64(1))
    yes = np.empty((len(start), bits), np.uint8)
    for k in range(bits // 64):
        salt = np.uint64((k + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1)
        for lo in range(0, len(start), 4096):  # some hundred thousand terms at a time
            own = start[lo : lo + 4096]
            end = start[lo + 4096] if lo + 4096 < len(start) else len(key)
            each = np.unpackbits(common.mix(base[own[0] : end] + salt).view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
            yes[lo : lo + 4096, 64 * k : 64 * k + 64] = np.add.reduceat(each, own - own[0], axis=0).view(np.uint8)
    total = np.add.reduceat(yes.astype(np.int32), np.cumsum(steps) - steps, axis=0)
    out = np.zeros((n, bits // 8), np.uint8)
    out[of[first]] = np.packbits(2 * total > size[:, None], axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS



def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


class Ranges:
    """Parts of the order: (complement of the id, text's digest) for named documents, digests for unnamed ones."""

    def __init__(self, marks: list[int], unnamed: int):
        # an id that is several marks at once holds that many parts: its digests are cut into equal ranges
        self.ids = np.sort(~np.array(marks, np.int64))
        self.digests = np.zeros(len(marks), np.uint64)
        for k in np.flatnonzero(np.r_[False, self.ids[1:] == self.ids[:-1]]):
            same = int((self.ids == self.ids[k]).sum())
            nth = int(k) - int(np.searchsorted(self.ids, self.ids[k]))
            self.digests[k] = np.uint64(nth * ((1 << 64) // same))
        self.unnamed = np.array([k * ((1 << 64) // max(unnamed, 1)) for k in range(1, unnamed)], np.uint64)

    def of(self, ids: np.ndarray, unnamed: np.ndarray, digests: np.ndarray) -> np.ndarray:
        key = ~ids
        low, high = np.searchsorted(self.ids, key, side="left"), np.searchsorted(self.ids, key, side="right")
        part = high.copy()
        for i in np.flatnonzero(high - low > 1):
            part[i] = low[i] + int((self.digests[low[i] : high[i]] <= digests[i]).sum())
        part[unnamed] = len(self.ids) + 1 + np.searchsorted(self.unnamed, digests[unnamed], side="right")
        return part.astype(np.int32)


def in_order(docs: DataFrame) -> DataFrame:
    """(part, halo, id, unnamed, digest, text): documents by ranges of the order, texts compressed; a part's halo row, the
    document after its last one, follows it.

    Ranges come from quantiles of the ids. A second pass finds the first document of each part, so that the third one can
    send it to the part before, too; only these few texts are sent twice.
    """
    n = common.parts(docs)
    ident = common.field("doc_id").cast("long")
    rows = docs.select(F.coalesce(ident, F.lit(0)).alias("id"), ident.isNull().alias("unnamed"), common.field("text").alias("text"))
    count, nulls = rows.agg(F.count(F.lit(1)), F.count_if("unnamed")).first()
    marks = rows.where("not unnamed").approxQuantile("id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 and count > nulls else []
    ranges = Ranges([int(x) for x in marks], -(-nulls * n // max(count, 1)))

    def columns(batch, texts):
        ids, unnamed = batch.column("id").to_numpy(), batch.column("unnamed").to_numpy(zero_copy_only=False).astype(bool)
        digests = np.array([int.from_bytes(hashlib.sha256(t).digest()[:8]) for t in texts], np.uint64)
        return ids, unnamed, digests, ranges.of(ids, unnamed, digests)

    def find_first(batches):
        found: dict[int, tuple] = {}
        for batch, texts in common.slices(batches):
            ids, _, digests, part = columns(batch, texts)
            order = np.lexsort((digests, ~ids, part))
            for i in order[np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])]:
                key = (int(~ids[i]), int(digests[i]))
                found[int(part[i])] = min(found.get(int(part[i]), key), key)
        made = [(p, ~k[0], k[1].to_bytes(8)) for p, k in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["part", "id", "digest"])

    heads = rows.mapInArrow(find_first, "part int, id long, digest binary").groupBy("part").agg(F.min(F.struct((-F.col("id")).alias("k"), "digest", "id")).alias("head"))
    heads = {r["part"]: (r["head"]["id"], int.from_bytes(r["head"]["digest"])) for r in heads.collect()}  # a row a part
    there = sorted(heads)
    before = {p: there[k - 1] for k, p in enumerate(there)}
    names = ["part", "halo", "id", "unnamed", "digest", "text"]

    def deal(batches):
        tight = zstandard.ZstdCompressor(level=3)
        for batch, texts in common.slices(batches):
            ids, unnamed, digests, part = columns(batch, texts)
            first = [i for i in range(len(texts)) if (int(ids[i]), int(digests[i])) == heads[int(part[i])]]
            packed = [tight.compress(t) for t in texts]
            of = np.r_[np.arange(len(texts)), np.array(first, np.int64)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[part, np.array([before[int(part[i])] for i in first], np.int32)].astype(np.int32)), pa.array(np.arange(len(of)) >= len(texts)),
                pa.array(ids[of]), pa.array(unnamed[of]), pa.array([int(digests[i]).to_bytes(8) for i in of], pa.binary()), pa.array([packed[i] for i in of], pa.binary()),
            ], names)

    dealt = rows.mapInArrow(deal, "part int, halo boolean, id long, unnamed boolean, digest binary, text binary")
    return dealt.repartitionById(max(there, default=0) + 1, F.col("part")).sortWithinPartitions("part", "halo", F.col("id").desc(), "digest")


COMPARED = {
    "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(),
    "near_next": pa.float64(), "head": pa.int64(), "tail1": pa.int64(), "tail2": pa.int64(),
}
_SQL = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}


def compare_edited(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how near these and the next text's are."""
    dealt = in_order(docs)

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        held = None  # the last row seen
        pairs: list = []
        size = 0
        for batch in batches:
            for part, halo, ident, unnamed, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "halo", "id", "unnamed", "text"))):
                row = (part, halo, None if unnamed else ident, unpack.decompress(packed).decode("utf-8", "surrogatepass"))
                if held is not None and held[0] == part and not held[1]:
                    pairs.append((held, row))
                    size += len(row[3])
                held = row
                if len(pairs) >= common.BATCH_ROWS or size >= common.BATCH_BYTES:
                    yield judged(pairs)
                    pairs, size = [], 0
        if pairs:
            yield judged(pairs)

    def judged(pairs):
        changed = [edited(a[3], b[3]) for a, b in pairs]
        # each text once: a document's next one is mostly the next pair's own
        texts = [a[3] for a, _ in pairs]
        apart = [k for k, (_, b) in enumerate(pairs) if k + 1 == len(pairs) or pairs[k + 1][0] is not b]
        prints = fingerprints(common.as_bytes(texts + [pairs[k][1][3] for k in apart]))
        own, following = prints[: len(pairs)], prints[np.arange(len(pairs)) + 1 - (np.arange(len(pairs)) + 1 == len(prints))].copy()
        following[apart] = prints[len(pairs) :]
        new = fingerprints(common.as_bytes(changed))
        whole = own.copy().view(">i8").astype(np.int64)
        made = (
            [len(t) for t in texts], [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed], [x.tobytes().hex() for x in own],
            [x.tobytes().hex() for x in new], likeness(own, new), likeness(own, following), whole[:, 0], whole[:, 1], whole[:, 2],
        )
        columns = [pa.array(x, kind) for x, kind in zip(made, COMPARED.values())]
        return pa.RecordBatch.from_arrays([pa.array([a[2] for a, _ in pairs], pa.int64()), *columns], ["doc_id", *COMPARED])

    return dealt.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {_SQL[k]}" for c, k in COMPARED.items()))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints (rows of three 64-bit words) are near each other."""
    return (np.bitwise_count(a[..., 0] ^ b[..., 0]) <= RADIUS) & (np.bitwise_count(a ^ b).sum(axis=-1) <= WHOLE_RADIUS)


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect all near fingerprints of one place; memory is linear in them.

    Breadth first; what is reached is not compared again, so a cluster of copies costs about its size.
    """
    edges, left = [], np.arange(len(prints))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(prints[left], prints[at])
            found, left = left[hit], left[~hit]
            edges += [(at, int(x)) for x in found]
            queue += found.tolist()
    return edges


def small_places(prints: np.ndarray, size: np.ndarray, left_in_place: np.ndarray) -> np.ndarray:
    """(k, 2): rows to connect, for many places one after the other: each row is compared with those that follow it in
    its place, all places at once, and rows already connected are not compared again."""
    label = np.arange(len(prints))
    for shift in range(1, int(size.max(initial=1))):
        a = np.flatnonzero(left_in_place >= shift)
        a = a[label[a] != label[a + shift]]
        a = a[np.bitwise_count(prints[a, 0] ^ prints[a + shift, 0]) <= RADIUS]
        a = a[near(prints[a], prints[a + shift])]
        while len(a):
            low, high = np.minimum(label[a], label[a + shift]), np.maximum(label[a], label[a + shift])
            np.minimum.at(label, high, low)
            while (label != label[label]).any():
                label = label[label]
            a = a[label[a] != label[a + shift]]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return np.stack([label[moved], moved], axis=1)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _mask(bits) -> int:
    return sum(1 << int(x) for x in bits)


@cache
def table_bits(blocks: int, radius: int = RADIUS) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """For each table its leading bits, and the bits that it leaves out. Blocks take every so many bits, so that prints which
    share a stretch of the head still part."""
    cuts = [range(k, HEAD, blocks) for k in range(blocks)]
    bits_of = lambda chosen: tuple(int(x) for c in chosen for x in cuts[c])
    return [(bits_of(chosen), bits_of(c for c in range(blocks) if c not in chosen)) for chosen in combinations(range(blocks), blocks - radius)]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Into how many blocks the head is cut for n fingerprints: more blocks make more tables, but with more leading bits
    and so smaller places. A row of a table costs about as much as ROW comparisons."""
    cost = lambda b: len(table_bits(b)) * (ROW + n / 2 ** len(table_bits(b)[0][0]))
    return min(range(radius + 2, radius + 7), key=cost)


@cache
def divisions(blocks: int, path: int, level: int, radius: int = RADIUS) -> tuple[int, tuple[int, ...]]:
    """(mask of the bits that must be equal, bits left) of a path: its table, then at each division the piece that is equal."""
    if level == 0:
        lead, rest = table_bits(blocks)[path]
        return _mask(lead), rest
    used, rest = divisions(blocks, path // (radius + 1), level - 1)
    piece = rest[path % (radius + 1) :: radius + 1]
    return used | _mask(piece), tuple(x for x in rest if x not in piece)


def meet(filed: DataFrame, keys: list[str], crowded: int | None) -> DataFrame:
    """Links within each place of ``filed`` (keys, head, tail1, tail2); rows of crowded places come back with ``again``.

    Places are runs of sorted rows, so a worker holds one place, or as many small ones as fill a batch.
    """
    words = ["head", "tail1", "tail2"]
    schema = ", ".join(["again boolean", "path int", *(f"{x}{w} long" for x in "ab" for w in words)])

    def made(again: bool, which, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(a), again)), pa.array(np.full(len(a), 0, np.int32) + which, pa.int32())]
        columns += [pa.array(np.ascontiguousarray(x[:, k]).view(np.int64)) for x in (a, b) for k in range(3)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    def places(key: np.ndarray, prints: np.ndarray):
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        size = np.diff(np.r_[first, len(key)])
        of = np.repeat(np.arange(len(first)), size)
        big = size > CROWDED
        if big.any():
            if crowded is None:
                for p in np.flatnonzero(big):
                    own = prints[first[p] : first[p] + size[p]]
                    edges = np.array(forest(own), np.int64).reshape(-1, 2)
                    yield made(False, 0, own[edges[:, 0]], own[edges[:, 1]])
            else:
                rows = np.flatnonzero(big[of])
                yield made(True, key[rows, 0].astype(np.int32), prints[rows], prints[rows])
        rows = np.flatnonzero(~big[of])
        if len(rows):
            after = (first[of] + size[of] - 1 - np.arange(len(key)))[rows]
            edges = small_places(prints[rows], size[~big], after)
            yield made(False, 0, prints[rows][edges[:, 0]], prints[rows][edges[:, 1]])

    def run(batches):
        held_key, held = np.zeros((0, len(keys)), np.int64), np.zeros((0, 3), np.uint64)
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys], axis=1)
            prints = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in words], axis=1)
            held_key, held = np.concatenate([held_key, key]), np.concatenate([held, prints])
            last = int(np.flatnonzero(np.r_[True, (held_key[1:] != held_key[:-1]).any(axis=1)])[-1]) if len(held_key) else 0
            if last >= 50_000 or (last and len(held_key) - last > CROWDED):
                yield from places(held_key[:last], held[:last])
                held_key, held = held_key[last:], held[last:]
            if crowded is not None and not last and len(held_key) > 50_000:
                # one crowded place so far: its rows go on at once, and keep enough to be known as crowded
                cut = len(held_key) - CROWDED - 1
                yield made(True, held_key[:cut, 0].astype(np.int32), held[:cut], held[:cut])
                held_key, held = held_key[cut:], held[cut:]
        if len(held_key):
            yield from places(held_key, held)

    n = common.parts(filed)
    return filed.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def divided(crowd: DataFrame, blocks: int, level: int) -> DataFrame:
    """(path, lead, head, tail1, tail2): the prints of crowded places, once for each piece of the bits left there."""
    words = ["head", "tail1", "tail2"]

    def run(batches):
        for batch in batches:
            path = batch.column("path").to_numpy()
            head = batch.column("head").to_numpy().view(np.uint64)
            known, which = np.unique(path, return_inverse=True)
            for piece in range(RADIUS + 1):
                below = known * (RADIUS + 1) + piece
                used = np.array([divisions(blocks, int(x), level)[0] for x in below], np.uint64)
                columns = [pa.array(below[which].astype(np.int32)), pa.array((head & used[which]).view(np.int64)), *(batch.column(c) for c in words)]
                yield pa.RecordBatch.from_arrays(columns, ["path", "lead", *words])

    return crowd.select("path", *words).mapInArrow(run, "path int, lead long, head long, tail1 long, tail2 long")


def close_prints(prints: DataFrame, blocks: int | None = None) -> DataFrame:
    """(a, b): links between the ids of distinct fingerprints (head, tail1, tail2) that connect every two near ones,
    through others if need be."""
    words = ["head", "tail1", "tail2"]
    blocks = blocks or blocks_for(prints.count())
    leads = F.array(*(F.lit(_signed(_mask(lead))).cast("long") for lead, _ in table_bits(blocks)))
    filed = prints.select(F.posexplode(leads).alias("path", "mask"), *words).select("path", F.col("head").bitwiseAND(F.col("mask")).alias("lead"), *words)
    links = None
    for level in range(DIVISIONS + 1):
        met = meet(filed, ["path", "lead"], CROWDED if level < DIVISIONS else None)
        met = common.cut(met) if level < DIVISIONS else met
        found = met.where("not again")
        links = found if links is None else links.unionByName(found)
        crowd = met.where("again").select("path", F.col("ahead").alias("head"), F.col("atail1").alias("tail1"), F.col("atail2").alias("tail2"))
        if level == DIVISIONS or crowd.isEmpty():
            break
        filed = divided(crowd, blocks, level + 1)
    return links.select(*(F.xxhash64(*(x + w for w in words)).alias(x) for x in "ab")).distinct()


def near_classes(compared: DataFrame) -> DataFrame:
    """(fingerprint, near_class): the least doc_id reachable through near fingerprints."""
    words = ["head", "tail1", "tail2"]
    prints = common.cut(compared.groupBy("fingerprint", *words).agg(F.min("doc_id").alias("id")).withColumn("node", F.xxhash64(*words)))
    labelled = prints.join(common.components(close_prints(prints.select(*words))), "node", "left").select("fingerprint", "id", F.coalesce("component", "node").alias("label"))
    least = labelled.groupBy("label").agg(F.min("id").alias("near_class"))
    return labelled.join(least, "label").select("fingerprint", "near_class")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = common.cut(compare_edited(common.read(spark, sf_dir, "documents")))
    names = [c for c in compared.columns if c not in ("head", "tail1", "tail2")]
    return common.join_spread(compared.select(*names), near_classes(compared), "fingerprint").select(*names, "near_class")


QUERIES = {"op6_simhash": op6_simhash}
ORACLE_SQL: dict[str, str] = {}
