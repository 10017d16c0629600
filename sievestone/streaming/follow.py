"""Following files that are added to a folder, and searching them as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import checked


def follow_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of (path, line) of text files as they appear in the folder; each file is read once."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def follow_matches(spark: SparkSession, path: str, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    """Of follow_lines() those that hold the pattern."""
    return follow_lines(spark, path, files_per_batch).where(F.contains("line", F.lit(checked(pattern).decode())))


def follow_counts(spark: SparkSession, path: str, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    """(path, matching): running counts, for complete or update mode."""
    return follow_matches(spark, path, pattern, files_per_batch).groupBy("path").agg(F.count("*").alias("matching"))
