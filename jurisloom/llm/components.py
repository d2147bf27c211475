"""Connected components of an edge table, without any node's edges in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialise

MOST_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` (the smallest node of its component) for every node of ``edges``.

    Alternates large-star and small-star steps, in which each node tells its
    neighbours the smallest one it knows, until the edges stop changing; the
    number of rounds grows with the logarithm of the longest path.  Steps are
    aggregations and joins on a node with a table that is unique in it, so a
    node with very many edges is summed in the tasks and split by the join
    (the unique side is written first: a join over an aggregation in the same
    stage can't be split).  Each round is written to the shared folder, so lost executors cost a task
    and never the lineage.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    e = materialise(e, "edges")
    before = None

    def drop(*tables: DataFrame) -> None:
        for table in tables:
            if files := table.inputFiles():
                drop_path(spark, files[0].rsplit("/", 1)[0])

    for _ in range(MOST_ROUNDS):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u != v").distinct(), "large-star")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        linked = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialise(linked.union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "small-star")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        drop(e, large, least, low)
        e = small
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
