"""Helpers shared by the corpus operators: scratch tables and Arrow mapping."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

_LOCAL: list[str] = []


def _clean_local() -> None:
    for path in _LOCAL:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_clean_local)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session on this machine alone (unit tests, a laptop) may do without
    and gets a folder of this machine; on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="jurisloom-")
        _LOCAL.append(root.removeprefix("file://"))
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, deleted when the application ends."""
    path = f"{scratch_root(spark)}/jurisloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path whose readers are done."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialise(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and makes every
    later reader see one and the same result.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of the batches that go to and come from a worker; a longer row comes alone.
BATCH_BYTES = 4 << 20


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` with bounded memory.

    Batches are limited by bytes, not only by rows, so long texts don't add up
    (a smaller limit of the session stays).  After each task the worker gives
    freed memory back, as idle workers live on beside the executor's own work.
    """
    limit_batches(df.sparkSession)
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    names, out_names = df.columns, kind.names
    # Names with a dot can't be passed as they are, so columns go by number there.
    odd = any(re.search("[.`]", c) for c in (*names, *out_names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            if odd:
                for batch in fn(b.rename_columns(names) for b in batches):
                    yield batch.select([batch.schema.names.index(c) for c in out_names]).rename_columns([f"c{k}" for k in range(len(out_names))])
            else:
                yield from fn(batches)
        finally:
            release_memory()

    if not odd:
        return df.mapInArrow(run, kind)
    numbered = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(kind)])
    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, numbered).toDF(*out_names)


def limit_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not 0 < int(re.sub(r"\D", "", now) or 0) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that one string column holds about ``max_bytes`` in each part.

    A single longer value still comes whole, alone in its part.
    """
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if len(size) == 0:
        return
    part = np.cumsum(size) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_crc(col: str | Column) -> Column:
    """crc32 of the id written as decimal text; a null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def extended(df: DataFrame, **columns: str) -> StructType:
    """The schema of ``df`` with further columns; ``df`` itself stays as it is."""

    return StructType([*df.schema.fields, *(StructField(k, _parse_datatype_string(v)) for k, v in columns.items())])
