"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sitescope.sources.tables import spread

#: Bytes that separate words: \x20 and \x09-\x0D. ``bytes.split()`` uses the same set.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Workers take texts in slices of so many rows and bytes at most (one text at least), whatever the size of Arrow's batches.
BATCH_ROWS = 400
BATCH_BYTES = 4_000_000

#: Bytes of text that a chunk of documents holds on average.
CHUNK_BYTES = 4_000_000

#: Settings of registered queries: what an Arrow batch holds at most.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": "8388608b"}

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SLOTS = 64
#: Two independent tables: one gives the words' hashes, the other those that verify them.
_TABLES = np.random.default_rng(20240229).integers(0, 1 << 64, size=(2, _SLOTS * 256), dtype=np.uint64)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for a registered query. Queries bound Arrow's batches in their session, so that a worker and its executor
    never hold many long texts at once; operators called by themselves leave the session's settings alone."""
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, local sessions get a temporary one and
    others an error, as executors do not see the driver's own folders."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def cut_counting(df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
    """The rows with their lineage cut, and for how many of them the condition holds, counted as they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return out, seen.get["n"]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def field(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def wrapped(docs: DataFrame, *more: Column) -> DataFrame:
    """(row, more...): all columns of ``docs`` in one struct, so that no name of theirs can clash with an operator's own."""
    return docs.select(F.struct(*(field(c) for c in docs.columns)).alias("row"), *more)


def unwrapped(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``row``, in their order, with some of them changed."""
    return df.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in columns))


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches with a ``text`` column, cut by rows and bytes, each with its texts in UTF-8 (null: empty)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < batch.num_rows:
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
            part = batch.slice(at, end - at)
            yield part, utf8(part.column("text"))
            at, before = end, int(ends[end - 1])


def utf8(column: pa.Array) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def with_columns(batch: pa.RecordBatch, keep: tuple[str, ...], **more) -> pa.RecordBatch:
    """The batch's ``keep`` columns, untouched, and new ones. Ids pass as they are: no null turns a long into a float."""
    new = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in more.values()]
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + new, [*keep, *more])


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values evenly."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xCF1BBCDCB7A56463)
    return x ^ (x >> np.uint64(29))


def _hash_words(buf: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(start, hashes by each table) of each word of a buffer of bytes."""
    word = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, [np.zeros(0, np.uint64) for _ in tables]
    at = np.flatnonzero(word)
    length = end - start
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    pos = np.arange(len(at)) - np.repeat(first, length)
    place = (pos % _SLOTS) * 256 + buf[at]
    factor = None
    if length.max() > _SLOTS:
        far = pos // _SLOTS
        factor = np.uint64(2) * far.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D) + np.uint64(1)
    out = []
    for table in tables:
        value = table[place]
        if factor is not None:
            value *= factor
        out.append(mix(np.add.reduceat(value, first) + length.astype(np.uint64)))
    return start, out


def word_hashes(texts: list[bytes], slice_bytes: int = 400_000, tables: int = 1) -> tuple[np.ndarray, ...]:
    """64-bit hash of every word of every text, and the index of its text; with two ``tables`` a second, independent hash.

    Works on slices that end at white space, so memory stays bounded for very long texts.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    offsets = np.cumsum(sizes) - sizes
    whole = b"\n".join(texts)
    hashes, starts, at = [], [], 0
    while at < len(whole):
        end = at + slice_bytes
        if end < len(whole):
            buf = np.frombuffer(whole, np.uint8, min(slice_bytes, len(whole) - end), end)
            gap = np.flatnonzero(_SPACE[buf])
            while not len(gap) and end + len(buf) < len(whole):
                end += len(buf)
                buf = np.frombuffer(whole, np.uint8, min(slice_bytes, len(whole) - end), end)
                gap = np.flatnonzero(_SPACE[buf])
            end = end + int(gap[0]) if len(gap) else len(whole)
        else:
            end = len(whole)
        s, h = _hash_words(np.frombuffer(whole, np.uint8, end - at, at), _TABLES[:tables])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * (tables - 1)
    owner = np.searchsorted(offsets, np.concatenate(starts), side="right") - 1
    first, *more = (np.concatenate(h) for h in zip(*hashes))
    return first, owner, *more


def grams(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word's index, hash) of each run of k words within one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = hashes[:n].copy()
    for j in range(1, k):
        value *= _M
        value += hashes[j : j + n]
    inside = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return inside, mix(value[inside])


class Spans:
    """Hashes of any run of words, from running sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = np.full(n + 1, _M, np.uint64)
        inverse = np.full(n + 1, _M_INV, np.uint64)
        power[0] = inverse[0] = 1
        power, self.inverse = np.cumprod(power), np.cumprod(inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def pack(values: np.ndarray) -> bytes:
    """Compressed, byte plane by byte plane: upper bytes that hardly differ take no room."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes()) if len(values) else b""


def unpack(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def added_up(sent: DataFrame, width: int, seal: Callable = pack) -> DataFrame:
    """(block, counts): blocks of ``width`` packed counts (block, part, counts) added up, first within each part, so that
    no group holds the blocks of all tasks. ``seal`` makes what is kept of a block's sums, in the task that adds them up: a
    further function over them would take a second worker of each core, which lives on."""

    def adding(seal):
        def add(rows: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(width, np.int64)
            for x in rows["counts"]:
                total += unpack(x, np.int64)
            return pd.DataFrame({"block": [rows["block"].iloc[0]], "counts": [seal(total)]})

        return add

    return sent.groupBy("block", "part").applyInPandas(adding(pack), "block int, counts binary").groupBy("block").applyInPandas(adding(seal), "block int, counts binary")


def count_blocks(total: np.ndarray, width: int, part: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a table of counts that are not empty, as added_up() takes them."""
    blocks = total.reshape(-1, width)
    there = np.flatnonzero(blocks.any(axis=1))
    for lo in range(0, len(there), 64):
        own = there[lo : lo + 64]
        columns = [pa.array(own, pa.int32()), pa.array(np.full(len(own), part), pa.int32()), pa.array([pack(blocks[b]) for b in own], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "part", "counts"])


def as_bytes(texts) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def join_spread(left: DataFrame, right: DataFrame, on: str, share: int = 1000, salts: int = 64) -> DataFrame:
    """Left join to a table that holds each key once; keys of more than 1/share of the rows are dealt over ``salts`` tasks.

    At most ``share`` keys can be so frequent, so their list is bounded.
    """
    counts = left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    total = left.count()
    frequent = [r[0] for r in counts.where(F.col("n") * share > total).select(on).collect()] if total > share else []
    if not frequent:
        return left.join(right, on, "left")
    hot = F.coalesce(F.col(on).isin(frequent), F.lit(False))
    spread = F.when(hot, F.pmod(F.xxhash64(*(field(c) for c in left.columns)), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    both = left.withColumn("__salt", spread).join(right.withColumn("__salt", F.explode(copies)), [on, "__salt"], "left")
    return both.drop("__salt")


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``at``, their place in this order over all rows from 0 on, and ``part``, their partition of the sort.

    The sort is range-partitioned and written once; a partition's first place follows from the counts of those before it,
    one number for each partition.
    """
    placed = df.repartitionByRange(parts(df), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("part", F.shiftright("at", 33).cast("int")).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)))
    counts = sorted((r[0], r[1]) for r in placed.groupBy("part").count().collect())
    before, rows = 0, []
    for part, n in counts:
        rows.append((part, before))
        before += n
    first = df.sparkSession.createDataFrame(rows, "part int, __before long")
    return placed.join(F.broadcast(first), "part").withColumn("at", F.col("at") + F.col("__before")).drop("__before")


#: The table of the checksum CRC-32 by its polynomial, in SQL, for crc_sql().
CRC_SQL = """crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crc)"""


def crc_sql(text: str) -> str:
    """The unsigned checksum of a text's UTF-8 bytes; a query has ``crc_table`` beside its rows."""
    octets = f"list_transform(range(strlen({text})), lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component): the least node reachable, for every node of the edges.

    Large-star and small-star steps in turn, until all edges lead from a least node to nodes without any other edge, which
    is seen from the counts of smaller and larger neighbours; lineage is cut before and after each pair. No step keeps the
    neighbours of a node together: only their minimum and counts, which combine before the shuffle.
    """
    now = cut(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct())
    for _ in range(rounds):
        both = now.select(F.explode(F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")), F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")))).alias("e")).select("e.*")
        around = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count_if(F.col("v") > F.col("u")).alias("above"))
        least, unsettled = cut_counting(around, "below > 1 or (below = 1 and above > 0)")
        if not unsettled:
            break
        large = both.join(least.select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        ends = F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), "hi"))
        now = cut(large.join(low, "hi").select(F.explode(ends).alias("e")).select("e.*").where("lo < hi").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).union(now.select("lo", "lo").distinct())
