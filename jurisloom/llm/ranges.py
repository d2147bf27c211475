"""Buckets of neighbouring ids, of about equal numbers of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BUCKETS = 65_536


def bounds_of(df: DataFrame, id_col: str, bucket_bytes: int, text_col: str = "text") -> tuple[list[int], int | None]:
    """Ids that end buckets of about ``bucket_bytes`` of text, and the largest id."""
    n, total, top = df.agg(F.count("*"), F.sum(F.octet_length(text_col)), F.max(id_col)).head()
    by_size, cores = math.ceil((total or 0) / bucket_bytes), df.sparkSession.sparkContext.defaultParallelism
    # Small tables still use the cores there are, in buckets of at least 1 MB.
    spread = min(2 * cores, math.ceil((total or 0) / min(1 << 20, bucket_bytes)))
    buckets = max(1, min(MOST_BUCKETS, max(by_size, spread), n))
    if buckets == 1 or top is None:
        return [], top
    shares = [k / buckets for k in range(1, buckets)]
    found = df.agg(F.percentile_approx(id_col, shares, max(10_000, 20 * buckets))).head()[0]
    return sorted({x for x in found if x < top}), top


def bucket_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds below the id, by bisection; null ids go with the smallest."""
    if not bounds:
        return F.lit(0)
    table = F.lit(bounds).cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def step(at: Column, s: Column) -> Column:
        further = (at + s <= len(bounds)) & (F.element_at(table, F.least(at + s, F.lit(len(bounds)))) < doc_id)
        return F.when(further, at + s).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)
