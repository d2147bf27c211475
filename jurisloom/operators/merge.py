"""Upserts as merges of an old snapshot with new rows, and snapshots on plain files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: What a column takes when both sides have the key.
NEW, OLD, FILLED = "new", "old", "filled"


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: Mapping[str, str | Column] | None = None, default: str = NEW) -> DataFrame:
    """Full outer merge on ``keys``; ``new`` has one row for each key.

    Per column: ``new`` overwrites, ``old`` keeps the first value, ``filled`` takes
    the new value unless it is null; a column expression may use ``o.<name>`` and
    ``n.<name>``.
    """
    policy = dict(policy or {})
    o, n = old.withColumn("__has", F.lit(True)).alias("o"), new.withColumn("__has", F.lit(True)).alias("n")
    both = o.join(n, F.expr(" and ".join(f"o.`{k}` <=> n.`{k}`" for k in keys)), "full_outer")
    has_old, has_new = F.col("o.__has").isNotNull(), F.col("n.__has").isNotNull()
    out = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
    for c in old.columns:
        if c in keys:
            continue
        rule, a, b = policy.get(c, default), F.col(f"o.{c}"), F.col(f"n.{c}")
        merged = rule if isinstance(rule, Column) else {NEW: b, OLD: a, FILLED: F.coalesce(b, a)}[rule]
        out.append(F.when(has_old & has_new, merged).when(has_new, b).otherwise(a).alias(c))
    return both.select(*out)


def keep_if_empty(c: str) -> Column:
    """The new array unless it is empty."""
    return F.when(F.size(F.coalesce(F.col(f"n.{c}"), F.array())) == 0, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))


def object_merge(old: Column, new: Column) -> Column:
    """Shallow merge of two string maps; the right side wins, its nulls too."""
    old, new = F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without their parent (null keys have none to miss)."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def delete_cascade(parent: DataFrame, child: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents without the keys in ``gone``, and children without those parents."""
    return parent.join(gone.select(key), key, "left_anti"), child.join(gone.select(key), key, "left_anti")


def set_null(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is gone keep a null key."""
    known = parent.select(F.col(parent_key).alias("__parent")).distinct()
    joined = child.join(known, F.col(child_key) == F.col("__parent"), "left")
    return joined.withColumn(child_key, F.col("__parent")).drop("__parent").select(*child.columns)


class Snapshots:
    """A table on plain files: each version is a folder with a number, the highest whole one is the table.

    A version counts from the moment its writer has put its success mark there,
    and no version is touched afterwards, so a run that dies at any point leaves
    the table as it was.  One writer at a time: a second one that takes the same
    number fails.  Old versions stay until :meth:`purge`.
    """

    DONE = "_SUCCESS"

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), DataType.fromDDL(schema)

    def _files(self) -> tuple[object, object]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[tuple[int, bool]]:
        """Numbers of all versions in order, and whether each is whole."""
        store, path = self._files()
        if not store.exists(path):
            return []
        names = [f.getPath() for f in store.listStatus(path)]
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted((int(p.getName()[2:]), store.exists(mark(p, self.DONE))) for p in names if p.getName().startswith("v-"))

    def _folder(self, number: int) -> str:
        return f"{self.root}/v-{number:012d}"

    def read(self) -> DataFrame:
        whole = [n for n, done in self.versions() if done]
        return self.spark.read.schema(self.schema).parquet(self._folder(whole[-1])) if whole else self.spark.createDataFrame([], self.schema)

    def replace(self, df: DataFrame) -> None:
        taken = self.versions()
        number = taken[-1][0] + 1 if taken else 0
        df.select(*self.schema.names).write.mode("errorifexists").parquet(self._folder(number))
        if (number, True) not in self.versions():
            raise RuntimeError("the writer leaves no success mark; without one a version can't be told from half a one")

    def upsert(self, new: DataFrame, keys: list[str], policy: Mapping[str, str | Column] | None = None, default: str = NEW) -> None:
        old = self.read()
        self.replace(upsert(old, new.select(*old.columns), keys, policy, default))

    def append(self, new: DataFrame) -> None:
        self.replace(self.read().unionByName(new))

    def purge(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` whole versions, and broken ones before them."""
        store, _ = self._files()
        whole = [n for n, done in self.versions() if done]
        for n, _ in self.versions():
            if len(whole) >= keep and n < whole[-keep]:
                store.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(n)), True)
