"""JSON lines with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import last_wins


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file or folder; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_resumable(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Output of a run that may have been cut off: malformed lines are dropped and the last line of a key counts.

    The place of a line is its file and its byte order within it.
    """
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    placed = rows.filter(F.col(key).isNotNull()).withColumn("__seq", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return last_wins(placed, [key], "__seq").drop("__seq")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
