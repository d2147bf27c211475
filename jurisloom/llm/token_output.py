"""Token ids in bit-packed binary shards.

A shard file holds, one after another:

* ``MAGIC``;
* blocks of ``BLOCK_IDS`` ids (the last one shorter), each id in the smallest
  number of bits that every id of the vocabulary fits in, little-endian bit
  order, every block starting at a byte;
* block offsets (uint64, one more than blocks), document ids (int64), a byte
  for each document id that tells null (0) from value (1), and document starts
  within the shard (uint64, one more than documents);
* a JSON trailer (``bits``, ``block_ids``, ``n_ids``, ``n_docs``, positions of
  the tables), its length as uint32, and ``MAGIC`` again.

A reader seeks to any block by its offset and unpacks it with numpy alone.
Shard numbers follow the order of document ids, so shard ``k`` continues where
``k - 1`` ended (numbers of empty ranges are left out).
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_arrow, materialise, scratch_path, slices, text_or_empty
from .encoding import SLICE_BYTES, coder, text_encoder
from .files import read_file, whole_file
from .ranges import bounds_of, bucket_of

MAGIC = b"JLTOKEN1"
BLOCK_IDS = 65_536
#: Text of a shard, about.
SHARD_BYTES = 16 << 20
#: Ids that one read task takes, about.
READ_IDS = 4_000_000


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def width_of(vocab_size: int) -> str:
    """The numpy type that ids travel in."""
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids side by side in ``bits`` bits each, low bits first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(wide.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The inverse of :func:`pack`, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    return flat.reshape(count, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class ShardWriter:
    """Appends documents to a shard; holds one block of ids and 17 bytes a document."""

    def __init__(self, out: pa.NativeFile, bits: int) -> None:
        self.out, self.bits = out, bits
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.offsets, self.doc_ids, self.known, self.starts = [len(MAGIC)], [], bytearray(), [0]
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        done = 0
        while len(flat) - done >= BLOCK_IDS or last and done < len(flat):
            data = pack(flat[done : done + BLOCK_IDS], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
            done += BLOCK_IDS
        rest = flat[done:]
        self.waiting, self.n_waiting = [rest], len(rest)

    def close(self) -> None:
        self._flush(True)
        at, tables = self.offsets[-1], {}
        for name, data in (
            ("offsets", np.array(self.offsets, "<u8").tobytes()),
            ("doc_ids", np.array(self.doc_ids, "<i8").tobytes()),
            ("known", bytes(self.known)),
            ("starts", np.array(self.starts, "<u8").tobytes()),
        ):
            self.out.write(data)
            tables[name] = [at, len(data)]
            at += len(data)
        trailer = json.dumps(
            {"bits": self.bits, "block_ids": BLOCK_IDS, "n_ids": self.n_ids, "n_docs": len(self.doc_ids)} | tables
        ).encode()
        self.out.write(trailer + struct.pack("<I", len(trailer)) + MAGIC)


class ShardReader:
    """Random access to a shard."""

    def __init__(self, uri: str) -> None:
        self.f = read_file(uri)
        size = self.f.size()
        tail = self._at(size - len(MAGIC) - 4, len(MAGIC) + 4)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} isn't a whole token shard")
        n = struct.unpack("<I", tail[:4])[0]
        self.head = json.loads(self._at(size - len(MAGIC) - 4 - n, n))
        table = lambda name, kind: np.frombuffer(self._at(*self.head[name]), kind)
        self.offsets, self.starts = table("offsets", "<u8"), table("starts", "<u8").astype(np.int64)
        self.doc_ids, self.known = table("doc_ids", "<i8"), table("known", np.uint8).astype(bool)

    def _at(self, position: int, n: int) -> bytes:
        return self.f.read_at(n, position)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the shard; reads only the blocks that hold them."""
        if end <= start:
            return np.empty(0, np.uint32)
        size, bits = self.head["block_ids"], self.head["bits"]
        first, last = start // size, (end - 1) // size
        data = self._at(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        out = []
        for k in range(first, last + 1):
            a, b = int(self.offsets[k] - self.offsets[first]), int(self.offsets[k + 1] - self.offsets[first])
            out.append(unpack(data[a:b], min(size, self.head["n_ids"] - k * size), bits))
        return np.concatenate(out)[start - first * size : end - first * size]

    def close(self) -> None:
        self.f.close()


def encoded(df: DataFrame, path: str, end_id: int | None = 0) -> DataFrame:
    """``bucket, id, ids`` of ``bucket, id, text`` rows: ids as little-endian numbers of 2 or 4 bytes.  Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(path)
        kind = width_of(encode.code.vocab_size)
        end = np.array([] if end_id is None else [end_id], kind).tobytes()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                ids = [x.astype(kind).tobytes() + end for x in encode.encode_many(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("id"), pa.array(ids, pa.binary())], names=["bucket", "id", "ids"])

    return map_arrow(df, run, "bucket int, id long, ids binary")


def write_shards(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0,
    directory: str | None = None, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode ``df`` into shards in ascending id order (null ids first, equal ids by their tokens).

    Returns a row per shard: ``shard, file, n_docs, n_ids, start`` (ids of all
    shards before it).  Ids must be whole numbers or cast to such.  Null texts
    are empty ones, repeated rows are all written, other columns are left out;
    an empty table gives no shard.  Texts are encoded where they are read; one
    shuffle moves their ids, by ranges of the document id, and tasks stream
    through their rows.
    """
    spark = df.sparkSession
    directory = directory or scratch_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab_size, number = coder(path).vocab_size, TaskContext.get().partitionId()
        kind, name = width_of(vocab_size), f"shard-{number:08d}.tok"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with whole_file(directory, name) as out:
            w = ShardWriter(out, bits_for(vocab_size))
            for batch in chain([first], batches):
                for doc_id, ids in zip(batch.column("id").to_pylist(), batch.column("ids"), strict=True):
                    w.add(doc_id, np.frombuffer(ids.as_buffer(), kind))
            w.close()
        yield pa.RecordBatch.from_pydict(
            {"shard": [number], "file": [f"{directory}/{name}"], "n_docs": [len(w.doc_ids)], "n_ids": [w.n_ids]}
        )

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    bounds, _ = bounds_of(rows, "id", shard_bytes)
    rows = encoded(rows.select(bucket_of(F.col("id"), bounds).alias("bucket"), "id", "text"), path, end_id)
    rows = rows.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("id", "ids").select("id", "ids")
    # A row per shard: few, whatever the size of the corpus, so they go to one file.
    shards = materialise(map_arrow(rows, run, "shard long, file string, n_docs long, n_ids long").repartition(1), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_shards(shards: DataFrame) -> DataFrame:
    """Documents of the shards: ``doc_id, start, n_tokens, ids_crc32`` from the files' own bytes.

    No shard gives no row; null ids come back as null.

    Read tasks get about ``READ_IDS`` ids each, by the shards' document tables,
    so one large shard is read by many tasks.  A document longer than that is
    still streamed, block by block.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_ids") / READ_IDS)).cast("int")
    tasks = shards.select("file", "start", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    n = shards.agg(F.sum(parts)).head()[0] or 1
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(row["file"])
                starts = shard.starts
                low, high = np.searchsorted(starts[:-1], [row["part"] * READ_IDS, (row["part"] + 1) * READ_IDS])
                crcs, at = [], low
                while at < high:
                    stop = max(at + 1, int(np.searchsorted(starts, starts[at] + READ_IDS // 4, "right")) - 1)
                    stop = min(stop, high)
                    if starts[stop] - starts[at] <= READ_IDS:
                        flat = shard.ids(int(starts[at]), int(starts[stop])).astype("<u4").tobytes()
                        cut = (starts[at : stop + 1] - starts[at]) * 4
                        view = memoryview(flat)
                        crcs += [zlib.crc32(view[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    else:
                        crc = 0
                        for k in range(int(starts[at]), int(starts[stop]), BLOCK_IDS):
                            ids = shard.ids(k, min(k + BLOCK_IDS, int(starts[stop])))
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    at = stop
                known = shard.known[low:high]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids[low:high], mask=~known),
                        pa.array(starts[low:high] + row["start"]),
                        pa.array(np.diff(starts[low : high + 1])),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                shard.close()

    return map_arrow(tasks.repartition(int(min(n, 20_000))), run, schema)


def token_output(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write ``df`` as shards, then give what the files hold for each document; edges as of the two."""
    return read_shards(write_shards(df, path, id_col, text_col, end_id))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token shards, read back."""
    import public_tokenizers

    return token_output(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
