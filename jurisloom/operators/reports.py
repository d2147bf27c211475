"""Counting reports, latest rows, pivots and set comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(**frames: DataFrame) -> DataFrame:
    """One row with the number of rows of each frame.

    Each is counted on its own and the one-row results are joined.
    """
    counted = [df.agg(F.count("*").alias(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.join(b, F.lit(True)), counted)


def top_groups(df: DataFrame, label: Column, limit: int | None = None, unknown: str = "INCONNU") -> DataFrame:
    """``label, n``: groups by falling count, then label; null labels under one name."""
    grouped = df.groupBy(F.coalesce(label, F.lit(unknown)).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")
    return grouped.limit(limit) if limit else grouped


def counters(df: DataFrame, *columns: str, missing: str = "<NONE>") -> DataFrame:
    """``what, value, n``: how often each column has each value.  One pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("what"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value")) for c in columns))
    return df.select(F.inline(pairs)).groupBy("what", "value").agg(F.count("*").alias("n"))


def children_of(parents: DataFrame, children: DataFrame, on: Column, keys: list[str], child_id: str, limit: int | None = None) -> DataFrame:
    """Parents with their number of matching children, zero included."""
    grouped = parents.join(children, on, "left").groupBy(*keys).agg(F.count(child_id).alias("n")).orderBy(F.desc("n"), *keys)
    return grouped.limit(limit) if limit else grouped


def latest(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Of each key the value of the row that is last by ``order``."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def earliest(df: DataFrame, key: str, value: str, when: str, never: str = "9999-12-31") -> DataFrame:
    """Of each key the value of the first row by date (no date: last), then by value."""
    order = F.struct(F.coalesce(F.col(when).cast("string"), F.lit(never)), F.col(value))
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def pivot_attributes(df: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """Attribute rows as columns: ``<name>_value`` (null unless there is just one), ``<name>_n`` and ``<name>_status``."""
    distinct = df.select(key, name, value).distinct()
    aggregates = []
    for x in names:
        mine = F.when(F.col(name) == x, F.col(value))
        n = F.count(mine)
        aggregates += [
            F.when(n == 1, F.max(mine)).alias(f"{x}_value"), n.alias(f"{x}_n"),
            F.when(n == 1, "UNIQUE").when(n > 1, "MULTIPLE").otherwise("MISSING").alias(f"{x}_status"),
        ]
    return distinct.groupBy(key).agg(*aggregates)


def agreement(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """Sets of items of both sides by key: counts and EXACT or DISAGREEMENT.

    Items compare trimmed and in lower case.
    """
    level = lambda df, side: df.select(key, F.lower(F.trim(F.col(item))).alias("item")).distinct().withColumn("side", F.lit(side))
    both = level(left, 1).union(level(right, 2)).groupBy(key, "item").agg(F.sum("side").alias("sides"))
    out = both.groupBy(key).agg(
        F.count_if(F.col("sides") == 3).alias("shared"), F.count_if(F.col("sides") == 1).alias("only_left"), F.count_if(F.col("sides") == 2).alias("only_right")
    )
    return out.withColumn("agreement", F.when(F.col("only_left") + F.col("only_right") == 0, "EXACT").otherwise("DISAGREEMENT"))


def missing_ids(known: DataFrame, wanted: list[str], key: str) -> list[str]:
    """Which of a few requested ids don't exist."""
    have = {r[0] for r in known.filter(F.col(key).isin(wanted)).select(key).distinct().collect()}
    return [x for x in dict.fromkeys(wanted) if x not in have]
