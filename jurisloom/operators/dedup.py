"""Order-dependent deduplication and key collisions, without sorting a key's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_of_each(df: DataFrame, keys: list[str], seq: str | Column, last: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    order = F.col(seq) if isinstance(seq, str) else seq
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.groupBy(*keys).agg(pick(row, order).alias("__row")).select("__row.*")


def last_wins(df: DataFrame, keys: list[str], seq: str | Column) -> DataFrame:
    """The row of the largest ``seq`` of each key."""
    return _one_of_each(df, keys, seq, True)


def first_seen(df: DataFrame, keys: list[str], seq: str | Column) -> DataFrame:
    """The row of the smallest ``seq`` of each key."""
    return _one_of_each(df, keys, seq, False)


def last_filled(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of each key and column, the last value that isn't null: what upserts that keep old values end in."""
    rest = [c for c in df.columns if c not in (*keys, seq)]
    return df.groupBy(*keys).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest))


def collisions(df: DataFrame, key: str, value: str, counted: str = "n", values: str = "values") -> DataFrame:
    """Keys with more than one distinct value, and the sorted values."""
    distinct = df.select(key, value).distinct()
    return distinct.groupBy(key).agg(F.count("*").alias(counted), F.array_sort(F.collect_list(value)).alias(values)).filter(F.col(counted) > 1)


def strict_candidates(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Extracted candidates, the first of each identity."""
    return first_seen(df, keys, position)
