"""Operator 10: WARC archives, written from pages and read back by byte ranges.

Writing: one gzip member a record, a file a task, into a folder that all executors share. Of pages with equal payloads
of at least MIN_REVISIT bytes the one with the smallest id becomes a response, the others revisits of it.

Reading: a file's byte ranges are dealt to tasks. A task looks for gzip's magic bytes in its range, accepts a place as
a record's start only if the member there decodes to a WARC header, and reads each record that starts inside its range
to its end, even beyond the range. So each record belongs to one range, wherever the cuts fall.

A null html is an empty payload. Pages with a null id are written and read as such; among equal payloads they never
serve as the response unless all ids are null. Rows that repeat the response's id and payload are responses, too. An empty
table gives no archives and no rows. Very long payloads are compressed and read as streams of one record at a time.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.llm import common

MIN_REVISIT = 100
SPLIT_BYTES = 4_000_000
READ_BYTES = 1 << 16
MAGIC = b"\x1f\x8b\x08"
MARKED = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///"))


def mark_revisits(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): refers_to is null for responses.

    Only digests and ids are grouped, with partial aggregation. Of the payloads only those of responses are written, and
    the join back deals a frequent digest over several tasks.
    """
    base = pages.select(F.col(key).cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    large = base.where(F.col("payload_bytes") >= MIN_REVISIT)
    firsts = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first_id")
    joined = common.join_spread(base, firsts, "payload_digest")
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One record, uncompressed. A revisit carries headers only."""
    name = "null" if page_id is None else str(page_id)
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        body += payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(marked: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write one archive a task; (path, records, bytes) of each. A retried task writes a file of another name, and only
    files listed here count."""

    def write(batches):
        path, sink, at, records = None, None, 0, 0
        for batch in batches:
            for page_id, url, payload, size, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in MARKED)):
                if sink is None:
                    fs, root = open_fs(folder)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    sink = fs.open_output_stream(path, compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, payload, size, digest, refers_to)) + packer.flush()
                sink.write(member)
                at += len(member)
                records += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [at]})

    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    return marked.select(*MARKED).mapInArrow(write, "path string, records long, bytes long")


def _member(fs_file, size: int, at: int, probe: bytes = b"") -> tuple[bytes, int] | None:
    """(decoded member, its end), or None if no whole member starts at ``at``."""
    unpack = zlib.decompressobj(31)
    out, place, data = [], at, probe
    try:
        while True:
            if not data:
                if place >= size:
                    return None
                fs_file.seek(place)
                data = fs_file.read(READ_BYTES)
            out.append(unpack.decompress(data))
            place += len(data)
            if unpack.eof:
                return b"".join(out), place - len(unpack.unused_data)
            if len(out) == 1 and not out[0].startswith(b"WARC/") and len(out[0]) >= 5:
                return None
            data = b""
    except zlib.error:
        return None


def is_start(data: bytes) -> bool:
    """Whether a member that starts with this data decodes to the first bytes of a WARC header."""
    try:
        return zlib.decompressobj(31).decompress(data, 5) == b"WARC/"
    except zlib.error:
        return False


def read_range(uri: str, start: int, end: int):
    """(offset, decoded record) of every record that starts in [start, end)."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        at, whole = start, False  # whole: ``at`` is known to be a member's start
        while at < min(end, size):
            f.seek(at)
            data = f.read(READ_BYTES)
            if not whole:
                place = data.find(MAGIC)
                if place < 0:
                    at += max(1, len(data) - len(MAGIC) + 1)
                    continue
                if place:
                    at += place
                    continue
                if not is_start(data):
                    at += 1
                    continue
            found = _member(f, size, at, data) if data.startswith(MAGIC) else None
            if found is None:
                at, whole = at + 1, False
                continue
            yield at, found[0]
            at, whole = found[1], True


def parse(raw: bytes) -> dict:
    """Headers and payload of a record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    ident = lambda s: None if s is None or s == "<urn:page:null>" else int(s[len("<urn:page:") : -1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(fields["WARC-Payload-Length"])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": ident(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": ident(fields.get("WARC-Refers-To")),
    }


RECORD = {
    "path": pa.string(), "offset": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(),
    "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
}
_SQL = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
#: Records are handed on when so many, or payloads of so many bytes, are read.
HELD, HELD_BYTES = 500, 8_000_000


def read_archives(files: DataFrame, scheme: str, split_bytes: int = SPLIT_BYTES, columns: tuple[str, ...] = ()) -> DataFrame:
    """Records of the archives listed in ``files`` (path, bytes); with ``columns`` only those leave the workers."""
    splits = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("bytes") - 1), F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.select("path", "start", (F.col("start") + split_bytes).alias("end"))
    splits = splits.repartition(common.parts(files), "path", "start")
    kinds = {c: RECORD[c] for c in columns or RECORD}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()], list(kinds))

    def read(batches):
        for batch in batches:
            for split in batch.to_pylist():
                rows, held = [], 0
                for offset, raw in read_range(f"{scheme}{split['path']}", split["start"], split["end"]):
                    rows.append({c: x for c, x in ({"path": split["path"], "offset": offset} | parse(raw)).items() if c in kinds})
                    held += len(raw)
                    if len(rows) >= HELD or held >= HELD_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return splits.mapInArrow(read, ", ".join(f"{c} {_SQL[k]}" for c, k in kinds.items()))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.shared_dir(spark)
    folder = f"{root}/warc-{uuid.uuid4().hex}"
    files = common.cut(write_archives(mark_revisits(common.read(spark, sf_dir, "pages")), folder))
    scheme = "" if "://" not in root else root.split("://")[0] + "://"
    return read_archives(files, scheme, columns=("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


QUERIES = {"op10_warc": op10_warc}
ORACLE_SQL = {
    "op10_warc": f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""
}
