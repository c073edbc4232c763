"""Operator 2: packing documents into sequences by shortest-pack-first over the length histogram.

Each document's ids, with an end id, are cut into full sequences and one rest. The rests' lengths form a histogram of at
most SEQUENCE entries. Lengths are placed longest first, each into the shortest open pack, which is the one with the most
room left; only if not even that one has room does a new pack open. Equal packs are one pattern with a count, and a
pattern's count is split or moved as lengths are placed; so whole groups of equal packs move at once and the work depends
on the number of lengths, not of documents. Patterns are joined back to documents by rank: the documents of one length,
in the order of their partition and place in it, fill that length's slots one after the other.

A long text is encoded part by part, cut where no piece of the tokenizer reaches across; so memory follows a part and the
text's ids, and any run of white space has a way.

Null and empty texts hold the end id alone. Repeated rows are packed like any other, and so are rows with null ids. Ids
need not be unique: a rank belongs to a row. Long texts are cut into as many pieces as they need. An empty table gives no
rows.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitescope.llm import common

SEQUENCE = 2048
END_ID = 1
SPECIAL = "<|endoftext|>"
#: Characters of a part of a long text, so that memory follows the part.
PART = 1_000_000
#: White space of this length makes the rank-file encoder's regular expression run out of stack; such parts take the other way.
BLANKS = 50_000
_GAP = re.compile(r"(?<=\S) (?=\S)")
_BLANKS = re.compile(r"\s{%d}" % BLANKS)
_LOADED: dict[str, tuple] = {}


def _encoders(name: str):
    """The rank-file encoder for ordinary text, and the full tokenizer for texts that hold a special token's string."""
    if name not in _LOADED:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(name + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ordinary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _LOADED[name] = fast, Tokenizer.from_file(public_tokenizers.path(name + ".json"))
    return _LOADED[name]


def parts_of(text: str, size: int = PART) -> Iterator[str]:
    """A long text in parts that encode by themselves as they do within it: cut where one space stands between other characters."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def encoded(text: str, name: str = "byte_bpe_50k") -> np.ndarray:
    """The text's ids and the end id."""
    fast, full = _encoders(name)
    out = []
    for part in parts_of(text):
        if SPECIAL in part or "\x00" in part or len(part) > BLANKS and _BLANKS.search(part):
            ids = full.encode(part, add_special_tokens=False).ids
        else:
            ids = fast.encode_ordinary(part)
        out.append(np.array(ids, "<u4"))
    return np.concatenate([*out, np.array([END_ID], "<u4")])


def encode(text: str | None, name: str = "byte_bpe_50k") -> list[int]:
    return encoded(text or "", name).tolist()


PIECE = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}


def cut_pieces(docs: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, block, place): each document cut at multiples of ``size``.

    ``place`` numbers the pieces of one length within a block, which is a task's partition.
    """

    def run(batches):
        block, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch, texts in common.slices(batches):
            owner, rows = [], []
            for k, text in enumerate(texts):
                ids = encoded(text.decode("utf-8", "surrogatepass"))
                for at in range(0, len(ids), size):
                    own = ids[at : at + size]
                    owner.append(k)
                    rows.append((at, len(own), zlib.crc32(own.tobytes()), len(ids), block, seen[len(own)]))
                    seen[len(own)] += 1
            names = {**PIECE, "block": pa.int32(), "place": pa.int64()}
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), names.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int32())), *columns], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(c + ' long' for c in PIECE)}, block int, place long")


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of the pattern, count)] that hold every length as often as the histogram says.

    Open patterns are kept by their room; a length goes to a pattern with the most room, one copy to each of its packs
    (the packs of that pattern are then no longer the shortest). New packs open where no pack has room; each takes copies
    of the length while it has the most room itself.
    """
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []  # sorted
    full: dict[tuple[int, ...], int] = {}

    def add(pattern: tuple[int, ...], room: int, count: int) -> None:
        if not room:
            full[pattern] = full.get(pattern, 0) + count
            return
        if room not in by_room:
            by_room[room] = {}
            bisect.insort(rooms, room)
        by_room[room][pattern] = by_room[room].get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                each = max(1, size // length)
                whole, rest = divmod(left, each)
                if whole:
                    add((length,) * each, size - each * length, whole)
                if rest:
                    add((length,) * rest, size - rest * length, 1)
                break
            room = rooms[-1]
            pattern, count = by_room[room].popitem()
            if not by_room[room]:
                del by_room[room]
                rooms.pop()
            used = min(count, left)
            if count > used:
                add(pattern, room, count - used)
            add((*pattern, length), room - length, used)
            left -= used
    return list(full.items()) + [x for group in by_room.values() for x in group.items()]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, runs of ranks: (length, first_rank, each, first_sequence, offset).

    Ranks first_rank .. of a length fill ``each`` slots of one sequence after the other, from ``first_sequence`` on.
    """
    rows, sequence, used = [], 0, {}
    for pattern, count in patterns:
        offset, k = 0, 0
        while k < len(pattern):
            length = pattern[k]
            each = 1
            while k + each < len(pattern) and pattern[k + each] == length:
                each += 1
            rank = used.get(length, 0)
            rows.append((length, rank, each, sequence, offset))
            used[length] = rank + each * count
            offset += each * length
            k += each
        sequence += count
    return pd.DataFrame(rows, columns=["length", "first_rank", "each", "first_sequence", "offset"]).sort_values(["length", "first_rank"])


def ranked(pieces: DataFrame) -> DataFrame:
    """The pieces with ``rank``, 0-based among those of one length.

    A block's first rank is the sum of the blocks before it, computed on counts (lengths x blocks rows), so no window runs
    over the pieces of one length.
    """
    counts = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return pieces.join(first, ["length", "block"]).withColumn("rank", F.col("first") + F.col("place")).drop("first", "place", "block")


def pack(docs: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    # written once, so that blocks and places are fixed whatever is computed again later
    pieces = common.cut(cut_pieces(docs, size))
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    table = slots(shortest_pack_first(histogram, size))
    runs = {int(k): tuple(x[c].to_numpy() for c in ("first_rank", "each", "first_sequence", "offset")) for k, x in table.groupby("length")}
    shared = docs.sparkSession.sparkContext.broadcast(runs)  # grows with the lengths' number, not with the documents'
    names = ("doc_id", *PIECE)

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                first, each, first_sequence, at = shared.value[int(one)]
                rows = np.flatnonzero(length == one)
                k = np.searchsorted(first, rank[rows], side="right") - 1
                copy, slot = np.divmod(rank[rows] - first[k], each[k])
                sequence[rows] = first_sequence[k] + copy
                offset[rows] = at[k] + slot * one
            yield common.with_columns(batch, names, sequence_id=sequence, offset=offset)

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = ranked(pieces).select(*names, "rank")
    return placed.mapInArrow(place, f"doc_id {kind}, {', '.join(c + ' long' for c in PIECE)}, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"))


QUERIES = {"op2_packing": op2_packing}
ORACLE_SQL: dict[str, str] = {}
