"""WARC archives as chunked record tables.

A record travels as rows ``(record, chunk number, bytes)``: payloads are cut by
the engine's own functions before they reach a writer, the writer streams
chunks into a gzip member for each record, and the reader gives chunk rows
back, each with the digest of all bytes up to it.  Writer and reader hold one
chunk.  Before that a payload is whole: it comes as one value of an input row,
is hashed as such, and moves as such where repeats are too many to broadcast.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialise, scratch_path
from .files import read_stream, whole_file

CHUNK_BYTES = 1 << 20
#: Payloads at least this long are written once and revisited.
REVISIT_BYTES = 100
RECORD_PREFIX = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classify(pages: DataFrame, id_col: str = "page_id", payload: Column | None = None) -> DataFrame:
    """``pages`` with ``payload, payload_bytes, payload_digest, record_type, refers_to``.

    Only (digest, id) pairs are grouped, summed in the tasks first.  What repeats
    is written before the join: if it is small Spark broadcasts it and no payload
    moves, else a hot digest's payloads can be split over tasks.  Null payloads are empty
    and, like all short ones, responses.  Null ids count as larger than any
    other; rows that repeat an id with its payload are all responses.  Columns
    already called like the new ones are replaced, others stay.
    """
    body = (payload if payload is not None else F.coalesce(F.col("html"), F.lit(""))).cast("binary")
    rows = pages.withColumn("payload", body)
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = (
        rows.filter(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy(F.col("payload_digest").alias("__digest"))
        .agg(F.min(id_col).alias("__first"), F.count("*").alias("__n"))
        .filter("__n > 1")
        .drop("__n")
    )
    first = materialise(first, "repeated-payloads")
    rows = rows.join(first, (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") >= REVISIT_BYTES), "left")
    again = F.col("__first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__first"))
    return (
        rows.withColumn("record_type", F.when(again, F.lit("revisit")).otherwise(F.lit("response")))
        .withColumn("refers_to", F.when(again, F.col("__first")))
        .drop("__digest", "__first")
    )


def chunks(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of classified records, a record's rows side by side and in order.

    Revisits and empty payloads have one row without bytes.
    """
    stored = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    last = F.greatest(F.ceil(stored / chunk_bytes) - 1, F.lit(0)).cast("int")
    rows = records.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    part = F.expr(f"substring(payload, chunk * {chunk_bytes} + 1, {chunk_bytes})")
    return rows.withColumn("bytes", F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(part)).drop("payload")


def _header(r: dict) -> tuple[bytes, bytes]:
    """WARC header and HTTP header of a record."""
    revisit = r["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
    length = len(http) + (0 if revisit else r["payload_bytes"])
    url = (r["url"] or "").translate({c: None for c in range(32)})
    lines = [
        "WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: <{RECORD_PREFIX}{r['id']}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{r['payload_digest']}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {length}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_PREFIX}{r['refers_to']}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def write_archives(chunk_rows: DataFrame, directory: str, level: int = 1) -> DataFrame:
    """Write chunk rows (``id, url, record_type, refers_to, payload_bytes, payload_digest, chunk, bytes``).

    One archive a task, a gzip member a record; gives ``file, records``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name, records = f"pages-{TaskContext.get().partitionId():08d}.warc.gz", 0
        with whole_file(directory, name) as out:
            packer, due = None, 0

            def add(batch: pa.RecordBatch) -> None:
                nonlocal packer, due, records
                data = batch.column("bytes")
                for k, r in enumerate(batch.drop_columns(["bytes"]).to_pylist()):
                    if r["chunk"] == 0:
                        if due:
                            raise ValueError("a record's chunks are not side by side")
                        packer = zlib.compressobj(level, wbits=31)
                        out.write(packer.compress(b"".join(_header(r))))
                        due = 0 if r["record_type"] == "revisit" else r["payload_bytes"]
                        records += 1
                    part = data[k].as_buffer()
                    if part is not None and part.size:
                        out.write(packer.compress(part))
                        due -= part.size
                    if due == 0:
                        out.write(packer.compress(b"\r\n\r\n") + packer.flush())

            add(first)
            for batch in batches:
                add(batch)
            if due:
                raise ValueError("the last record isn't whole")
        yield pa.RecordBatch.from_pydict({"file": [f"{directory}/{name}"], "records": [records]})

    return map_arrow(chunk_rows, run, "file string, records long")


class _Member:
    """Bytes of a gzip file, unpacked as asked for; members follow one another."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.raw, self.ready, self.unzip = stream, b"", bytearray(), None

    def fill(self, n: int) -> bool:
        """Have at least ``n`` bytes ready, or all that are left."""
        while len(self.ready) < n:
            if not self.raw:
                self.raw = self.stream.read(1 << 18)
                if not self.raw:
                    return len(self.ready) > 0
            if self.unzip is None or self.unzip.eof:
                self.unzip = zlib.decompressobj(wbits=31)
            self.ready += self.unzip.decompress(self.raw, 1 << 20)
            self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
        return True

    def take(self, n: int) -> bytes:
        self.fill(n)
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def until(self, mark: bytes) -> bytes:
        while True:
            at = self.ready.find(mark)
            if at >= 0:
                return self.take(at + len(mark))
            had = len(self.ready)
            self.fill(had + 1)
            if len(self.ready) == had:
                raise ValueError("an archive ends within a record")


def records_of(stream: pa.NativeFile, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """``(headers, stated payload bytes, chunk, offset, bytes, running digest, last)`` of every record's chunks."""
    m = _Member(stream)
    while m.fill(1):
        lines = m.until(b"\r\n\r\n").decode().split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:] if x)
        http = m.until(b"\r\n\r\n")
        stated = int(http.lower().split(b"content-length: ", 1)[1].split(b"\r\n", 1)[0])
        left, offset, chunk, digest = int(head["Content-Length"]) - len(http), 0, 0, hashlib.sha256()
        while True:
            part = m.take(min(left, chunk_bytes))
            if len(part) < min(left, chunk_bytes):
                raise ValueError("an archive ends within a payload")
            digest.update(part)
            left -= len(part)
            yield head, stated, chunk, offset, part, digest.hexdigest(), left == 0
            offset, chunk = offset + len(part), chunk + 1
            if left == 0:
                break
        if m.take(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its header says")


RECORDS = (
    "id long, record_type string, refers_to long, url string, stated_bytes long, stated_digest string, "
    "chunk int, offset long, n_bytes int, running_digest string, last boolean, bytes binary"
)


def read_archives(files: DataFrame, chunk_bytes: int = CHUNK_BYTES, payload: bool = True) -> DataFrame:
    """Chunk rows of archives (``file`` column); without ``payload`` the bytes stay null."""
    n = max(1, files.count())
    schema = pa.schema(
        [("id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("stated_bytes", pa.int64()), ("stated_digest", pa.string()),
         ("chunk", pa.int32()), ("offset", pa.int64()), ("n_bytes", pa.int32()), ("running_digest", pa.string()), ("last", pa.bool_()), ("bytes", pa.binary())]
    )

    def number(urn: str | None) -> int | None:
        if urn is None:
            return None
        value = urn.strip("<>").removeprefix(RECORD_PREFIX)
        return None if value == "None" else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows, size = [], 0
                with read_stream(file) as stream:
                    for head, stated, chunk, offset, part, digest, last in records_of(stream, chunk_bytes):
                        rows.append(
                            (number(head["WARC-Record-ID"]), head["WARC-Type"], number(head.get("WARC-Refers-To")), head["WARC-Target-URI"], stated,
                             head["WARC-Payload-Digest"].removeprefix("sha256:"), chunk, offset, len(part), digest, last, part if payload else None)
                        )
                        size += len(part) if payload else 0
                        if len(rows) >= 10_000 or size >= 4 * chunk_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return map_arrow(files.select("file").repartition(min(n, 20_000)), run, RECORDS)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", directory: str | None = None) -> DataFrame:
    """Write ``pages`` as archives (once) and give their files.

    Null payloads and addresses are empty ones, repeated rows are all written, ids
    are whole numbers or cast to such, other columns are left out; no page, no file.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    records = classify(rows, "id").drop("html")
    return materialise(write_archives(chunks(records), directory or scratch_path(spark, "warc")), "warc-files")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives, read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rows = read_archives(archive(pages), payload=False).filter("last")
    full = F.col("record_type") == "response"
    return rows.select(
        F.col("id").alias("page_id"),
        F.when(full, F.col("offset") + F.col("n_bytes")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(full, F.col("running_digest")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP9_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
