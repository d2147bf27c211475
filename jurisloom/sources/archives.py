"""XML members of tar.gz and ZIP archives, and plain XML files, as ``path, archive, seq, content`` rows.

Archives are Python data sources.  A gzip stream can't be split, so a tar.gz is
one partition, read as a stream and never unpacked; a ZIP has a directory and
is split into ranges of members.  Files are opened through Arrow's file systems.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, archive string, seq bigint, content binary"
MEMBERS_IN_PARTITION = 2_000


def _open(uri: str):
    store, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return store, path


def expand(uri: str, suffixes: tuple[str, ...]) -> list[str]:
    """The archives a path stands for; a wrong path or kind of file is an error at once."""
    store, path = _open(uri)
    scheme = uri.split("://")[0] + "://" if "://" in uri else ""
    info = store.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == pafs.FileType.File:
        if not path.lower().endswith(suffixes):
            raise ValueError(f"not an archive of {', '.join(suffixes)}: {uri}")
        return [f"{scheme}{path}"]
    found = store.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted(f"{scheme}{f.path}" for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(suffixes))


class _Part(InputPartition):
    def __init__(self, uri: str, first: int = 0, end: int | None = None) -> None:
        self.uri, self.first, self.end = uri, first, end


class TarReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = expand(options["path"], (".tar.gz", ".tgz"))

    def partitions(self) -> list[_Part]:
        return [_Part(f) for f in self.files] or [_Part("")]

    def read(self, part: _Part) -> Iterator[tuple]:
        if not part.uri:
            return
        store, path = _open(part.uri)
        with store.open_input_stream(path, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
            for seq, member in enumerate(tar):
                if member.isfile() and member.name.lower().endswith(".xml"):
                    yield member.name, part.uri, seq, tar.extractfile(member).read()


class ZipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = expand(options["path"], (".zip",))

    def partitions(self) -> list[_Part]:
        parts = []
        for uri in self.files:
            store, path = _open(uri)
            with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
                n = len(z.infolist())
            parts += [_Part(uri, a, min(n, a + MEMBERS_IN_PARTITION)) for a in range(0, n, MEMBERS_IN_PARTITION)]
        return parts or [_Part("")]

    def read(self, part: _Part) -> Iterator[tuple]:
        if not part.uri:
            return
        store, path = _open(part.uri)
        with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
            members = z.infolist()
            for seq in range(part.first, part.end):
                m = members[seq]
                if not m.is_dir() and m.filename.lower().endswith(".xml"):
                    yield m.filename, part.uri, seq, z.read(m)


class XmlTar(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xml_tar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)


class XmlZip(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xml_zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XmlTar)
    spark.dataSource.register(XmlZip)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """XML from a tar.gz, a ZIP, a single XML file or a folder (unreadable files are skipped)."""
    lower = path.lower()
    if lower.endswith((".tar.gz", ".tgz")):
        register(spark)
        return spark.read.format("xml_tar").load(path)
    if lower.endswith(".zip"):
        register(spark)
        return spark.read.format("xml_zip").load(path)
    store, local = _open(path)
    info = store.get_file_info(local)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File and not lower.endswith(".xml"):
        raise ValueError(f"not XML, tar.gz or ZIP: {path}")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").option("ignoreCorruptFiles", True)
    return reader.load(path).select("path", F.lit(path).alias("archive"), F.lit(0).cast("long").alias("seq"), "content")


def read_members(spark: SparkSession, zip_path: str, members: DataFrame, member_col: str = "member", tasks: int | None = None) -> DataFrame:
    """The wanted members of a ZIP with their content, by random access: nothing else is inflated.

    Each task opens the archive once and reads its share; members that aren't
    there are left out.
    """
    names = members.select(member_col).distinct().repartition(tasks or spark.sparkContext.defaultParallelism, member_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(zip_path)
        with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
            there = set(z.namelist())
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    if name in there:
                        yield pa.RecordBatch.from_pydict({"__member": [name], "content": pa.array([z.read(name)], pa.binary())})

    content = names.mapInArrow(run, "__member string, content binary").withColumnRenamed("__member", member_col)
    return members.join(content, member_col)


def zip_of(members: dict[str, bytes]) -> bytes:
    """A ZIP in memory, for tests and small exports."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()
