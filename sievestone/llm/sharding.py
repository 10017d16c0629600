"""Sharding: contiguous shards of nearly equal bytes, cut from global prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

SHARDS = 24


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row; law is 'bytes', grown_shard null.

    size is the text's UTF-8 bytes (null: none) plus 8. Rows are in order of id (nulls first), checksum and size; equal rows
    may change places, which changes nothing. Row r goes to the shard in which the middle of its bytes lies when all bytes
    are cut at equal targets, so a shard differs from its target by less than the largest row. slot counts from 0 in each
    shard, in the same order. The checksum of a null text is that of an empty one. No rows give no rows.
    No other column of docs is looked at.

    Rows are range-partitioned; the partitions' totals (a row each) give the offset that each partition starts from. Only
    ids, sizes and checksums are shuffled, never texts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    parts = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "sizes")
    totals = parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(whole).alias("total")
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        parts.withColumns({"end": F.sum("size").over(inside), "nth": F.count(F.lit(1)).over(inside)})
        .join(F.broadcast(starts), "part")  # a row for each partition
        .withColumns({"end": F.col("end") + F.col("bytes_before"), "nth": F.col("nth") + F.col("rows_before") - 1})
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (2 * `end` - size) * {shards} div (2 * total)) AS int)"))
    )
    placed = saved(placed.select("doc_id", "size", "text_crc32", "shard", "nth"), "placed")
    first = placed.groupBy("shard").agg(F.min("nth").alias("from"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
