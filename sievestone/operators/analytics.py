"""Structural analytics: mixes, histograms, ratios, lineage and runs; reports as rows, JSON or CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bar, log2_bucket, log2_label, ratio_bucket

CHUNK_HEADER = 4


def mix(df: DataFrame, by: str | Sequence[str], size: str | Column, header: int = CHUNK_HEADER) -> DataFrame:
    """(by..., count, bytes): rows and their bytes with headers, of each type."""
    keys = [by] if isinstance(by, str) else list(by)
    s = F.col(size) if isinstance(size, str) else size
    return df.groupBy(*keys).agg(F.count("*").alias("count"), F.sum(s.cast("long") + header).alias("bytes"))


def size_histogram(df: DataFrame, size: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bucket, count) of log2 buckets, 25 with an open last; sizes 0 and 1 are in bucket 0, nulls in none."""
    s = F.col(size) if isinstance(size, str) else size
    return df.where(s.isNotNull()).groupBy(*by, log2_bucket(s).alias("bucket")).agg(F.count("*").alias("count"))


def ratio_histogram(df: DataFrame, compressed: str, uncompressed: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bucket, count) of tenths of compressed / uncompressed."""
    return df.groupBy(*by, ratio_bucket(compressed, uncompressed).alias("bucket")).agg(F.count("*").alias("count"))


def draw(histogram: DataFrame, width: int = 40) -> DataFrame:
    """A histogram with labels and bars, in order of its buckets."""
    most = histogram.agg(F.max("count").alias("most"))
    return histogram.crossJoin(F.broadcast(most)).select("bucket", log2_label("bucket").alias("label"), "count", bar("count", F.col("most"), width).alias("bar")).orderBy("bucket")  # most: one row


def op_totals(ops: DataFrame, kind: str = "op", length: str = "length", offset: str = "offset", by: Sequence[str] = ()) -> DataFrame:
    """(by..., op, count, bytes, min and max of length and offset; null offsets are unset): partial sums merge in any order."""
    return ops.groupBy(*by, kind).agg(
        F.count("*").alias("count"), F.sum(length).alias("bytes"), F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.coalesce(F.min(offset), F.lit(0)).alias("min_offset"), F.coalesce(F.max(offset), F.lit(0)).alias("max_offset"), F.coalesce(F.sum(offset), F.lit(0)).alias("sum_offset")
    )


def merge_totals(*parts: DataFrame, kind: str = "op") -> DataFrame:
    """op_totals() of several inputs as those of all together."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    least = F.coalesce(F.min(F.when(F.col("min_offset") > 0, F.col("min_offset"))), F.lit(0))
    return rows.groupBy(kind).agg(F.sum("count").alias("count"), F.sum("bytes").alias("bytes"), F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"), least.alias("min_offset"), F.max("max_offset").alias("max_offset"), F.sum("sum_offset").alias("sum_offset"))


def lineage(df: DataFrame, partition: str, order: Sequence[str], kind: str, of: str | None = None) -> DataFrame:
    """(kind, previous, count): which kind comes before; null for the first of a partition. of: only before this kind."""
    w = Window.partitionBy(partition).orderBy(*order)
    rows = df.select(F.col(kind).alias("kind"), F.lag(kind).over(w).alias("previous"))
    rows = rows.where(F.col("kind") == of) if of is not None else rows
    return rows.groupBy("kind", "previous").agg(F.count("*").alias("count"))


def longest_runs(df: DataFrame, partition: str, order: Sequence[str], kind: str, weight: str | None = None) -> DataFrame:
    """(partition, kind, longest): the longest run of each kind, in rows or in the sum of `weight`. A run ends where the kind changes."""
    w = Window.partitionBy(partition).orderBy(*order)
    starts = df.select("*", F.when(F.col(kind).eqNullSafe(F.lag(kind).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1).alias("starts"))
    runs = starts.withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sized = runs.groupBy(partition, "run", kind).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return sized.groupBy(partition, kind).agg(F.max("n").alias("longest"))


def report(df: DataFrame, group: str, kind: str, size: Column) -> DataFrame:
    """(group, json): totals, mix and histogram of each group in one nested document."""
    base = df.select(F.col(group).alias("g"), F.col(kind).alias("k"), size.cast("long").alias("s"))
    totals = base.groupBy("g").agg(F.count("*").alias("count"), F.sum("s").alias("bytes"), F.min("s").alias("min"), F.max("s").alias("max"))
    kinds = base.groupBy("g", "k").agg(F.count("*").alias("count"), F.sum("s").alias("bytes")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct(F.col("k").alias("kind"), "count", "bytes"))).alias("mix"))
    hist = base.groupBy("g", log2_bucket("s").alias("bucket")).agg(F.count("*").alias("count")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("bucket", "count"))).alias("histogram"))
    met = totals.join(kinds, "g", "left").join(hist, "g", "left")
    return met.select(F.col("g").alias(group), F.to_json(F.struct("count", "bytes", "min", "max", "mix", "histogram")).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
