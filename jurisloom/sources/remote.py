"""Remote look-ups in batches, through an injected transport.

A batch that fails is halved until single keys are left, and a key that still
fails becomes an error row.  Answers are kept by the hash of their batch: within
a task in memory, and beyond it in a shared folder if one is given, so that a task
or a run that is repeated asks nobody twice.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "key string, status string, answer string, error string"


def batch_key(keys: list[str]) -> str:
    return hashlib.sha256("\n".join(keys).encode()).hexdigest()


class StoredAnswers:
    """Answers as files of a folder that workers share (any address that pyarrow knows)."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        self.found = fs.FileType.File
        self.store.create_dir(self.folder, recursive=True)

    def _path(self, key: str) -> str:
        return f"{self.folder}/{key}.json"

    def __contains__(self, key: str) -> bool:
        return self.store.get_file_info(self._path(key)).type == self.found

    def __getitem__(self, key: str) -> dict:
        with self.store.open_input_stream(self._path(key)) as f:
            return json.loads(f.read())

    def __setitem__(self, key: str, answer: dict) -> None:
        part = f"{self._path(key)}.{uuid.uuid4().hex}"
        with self.store.open_output_stream(part) as f:
            f.write(json.dumps(answer, ensure_ascii=False).encode())
        self.store.move(part, self._path(key))


def ask(keys: list[str], transport: Callable[[list[str]], dict[str, object]], retries: int = 4, pause: Callable[[float], None] = time.sleep, cache: dict | StoredAnswers | None = None) -> Iterator[tuple]:
    """``key, status, answer, error`` of every key; waits 1, 2, 4, ... (16 at most) seconds between tries."""
    if not keys:
        return
    cache = {} if cache is None else cache
    known = batch_key(keys)
    problem = None
    if known not in cache:
        for attempt in range(retries):
            try:
                cache[known] = transport(keys)
                break
            except Exception as e:  # noqa: BLE001 - any failure of the other side is a failed try
                problem = f"{type(e).__name__}: {e}"
                if attempt + 1 < retries:
                    pause(min(16.0, 2.0**attempt))
    if known in cache:
        answers = cache[known]
        for k in keys:
            found = answers.get(k)
            yield k, "FOUND" if found is not None else "MISSING", None if found is None else json.dumps(found, ensure_ascii=False, sort_keys=True), None
    elif len(keys) == 1:
        yield keys[0], "ERROR", None, problem
    else:
        half = len(keys) // 2
        yield from ask(keys[:half], transport, retries, pause, cache)
        yield from ask(keys[half:], transport, retries, pause, cache)


def look_up(df: DataFrame, key_col: str, transport_factory: Callable[[], Callable], batch: int = 250, retries: int = 4, pause: Callable[[float], None] = time.sleep, cache_uri: str | None = None) -> DataFrame:
    """One row per distinct key of ``df``.  The factory must be picklable; it makes each worker's transport.

    Keys go in order to batches, so that a repeated run makes the same batches
    and finds their answers under ``cache_uri``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transport, waiting, cache = transport_factory(), [], StoredAnswers(cache_uri) if cache_uri else {}
        columns = ["key", "status", "answer", "error"]
        for frame in frames:
            waiting += frame[key_col].tolist()
            while len(waiting) >= batch:
                yield pd.DataFrame(list(ask(waiting[:batch], transport, retries, pause, cache)), columns=columns)
                waiting = waiting[batch:]
        if waiting:
            yield pd.DataFrame(list(ask(waiting, transport, retries, pause, cache)), columns=columns)

    keys = df.select(key_col).filter(df[key_col].isNotNull()).distinct()
    return keys.sortWithinPartitions(key_col).mapInPandas(run, RESULT)


def pending(work: DataFrame, done: DataFrame, key: str, error_status: str = "SPARQL_ERROR") -> DataFrame:
    """Work not yet done, or done with an error."""
    return work.join(done.filter(done["status"] != error_status).select(key), key, "left_anti")
