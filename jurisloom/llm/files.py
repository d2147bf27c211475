"""Files that workers write to and read from the shared folder.

Workers reach the folder through :mod:`pyarrow.fs`, so any scheme that it knows
(``file``, ``hdfs``, ``s3``, ``gs``) works.  A file appears under its final name
only when it is whole, and a task that runs again replaces it by equal bytes.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def whole_file(directory: str, name: str) -> Iterator[pa.NativeFile]:
    """A stream to a file that gets its name when the block ends well."""
    store, base = open_fs(directory)
    store.create_dir(f"{base}/_unfinished", recursive=True)
    part, final = f"{base}/_unfinished/{name}.{uuid.uuid4().hex}", f"{base}/{name}"
    try:
        with store.open_output_stream(part) as out:
            yield out
        if store.get_file_info(final).type != pafs.FileType.NotFound:
            store.delete_file(final)
        store.move(part, final)
    except BaseException:
        with contextlib.suppress(OSError):
            store.delete_file(part)
        raise


def read_stream(uri: str) -> pa.NativeFile:
    store, path = open_fs(uri)
    return store.open_input_stream(path, compression=None)


def read_file(uri: str) -> pa.NativeFile:
    store, path = open_fs(uri)
    return store.open_input_file(path)
