"""The search log: appended as a stream, purged by age."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import QUERY_LOG

RETENTION_DAYS = 30


def retained(log: DataFrame, now: datetime | str, days: int = RETENTION_DAYS, column: str = "created_at") -> DataFrame:
    """Entries not strictly older than ``days`` before ``now``."""
    return log.filter(F.col(column) >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def append_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append JSON log lines that arrive in ``source`` to Parquet partitioned by day, once each."""
    lines = spark.readStream.schema(QUERY_LOG).json(source)
    days = lines.filter(F.length(F.trim("query")) > 0).withColumn("day", F.to_date("created_at"))
    return days.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()


def searches_by_hour(spark: SparkSession, source: str, late: str = "1 hour") -> DataFrame:
    """Streaming count of searches by hour; later entries than the watermark are dropped."""
    lines = spark.readStream.schema(QUERY_LOG).json(source)
    return lines.withWatermark("created_at", late).groupBy(F.window("created_at", "1 hour")).agg(F.count("*").alias("searches"))
