"""Streams and blocks: cutting, joining back, concatenation, following blocks' first bytes.

A block table has (stream_id, block_no, block_start, block_len, data, is_last). A stream may have any bytes; text streams
are their UTF-8 bytes. Blocks are the unit of parallel work and of pruning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_BLOCK, DEFAULT_BLOCK, MAX_BLOCK = 512, 2 << 20, 8 << 20


def streams(df: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(stream_id, data): a column of text or bytes as streams; null data is an empty stream."""
    data = F.col(data_col) if dict(df.dtypes)[data_col] == "binary" else F.encode(F.col(data_col).cast("string"), "UTF-8")
    return df.select(F.col(id_col).cast("long").alias("stream_id"), F.coalesce(data, F.lit(b"")).alias("data"))


def cut(streams_: DataFrame, block_size: int = DEFAULT_BLOCK, overlap: int = 0) -> DataFrame:
    """Blocks of block_size bytes, the last one of each stream shorter; an empty stream has none.

    With overlap > 0 the column next_head holds so many bytes that follow the block in its stream, however many blocks they span.
    A stream is cut where it is read: nothing is shuffled.
    """
    if not 1 <= block_size <= MAX_BLOCK:
        raise ValueError(f"a block has 1 to {MAX_BLOCK} bytes")
    n = F.length("data")
    cut_ = streams_.where(n > 0).select("stream_id", "data", n.alias("n"), F.explode(F.sequence(F.lit(0), F.expr(f"(length(data) - 1) div {block_size}"))).alias("k"))
    start = F.col("k") * block_size
    out = cut_.select(
        "stream_id",
        F.col("k").cast("int").alias("block_no"),
        start.cast("long").alias("block_start"),
        F.least(F.lit(block_size), F.col("n") - start).cast("int").alias("block_len"),
        F.substr("data", start.cast("int") + 1, F.lit(block_size)).alias("data"),
        (start + block_size >= F.col("n")).alias("is_last"),
        F.substr("data", start.cast("int") + block_size + 1, F.lit(max(overlap, 1))).alias("next_head"),
    )
    return out if overlap else out.drop("next_head")


def from_pieces(pieces: DataFrame) -> DataFrame:
    """Blocks from (stream_id, block_no, data) pieces of any lengths, such as flushes leave them: starts are running sums."""
    w = Window.partitionBy("stream_id").orderBy("block_no")
    start = F.coalesce(F.sum(F.length("data").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pieces.select(
        "stream_id", F.col("block_no").cast("int").alias("block_no"), start.alias("block_start"), F.length("data").alias("block_len"), "data", F.lead("block_no").over(w).isNull().alias("is_last")
    )


def with_next_head(blocks: DataFrame, overlap: int, shortest: int | None = None) -> DataFrame:
    """Blocks with next_head, from the blocks alone: the first `overlap` bytes of the following blocks of the stream.

    `shortest`: a lower bound on the lengths of all blocks but the last, where it is known: so many fewer blocks are looked at. Without it,
    any block may be empty but for one byte. Only heads are moved, not whole blocks.
    """
    if overlap <= 0:
        return blocks.withColumn("next_head", F.lit(b""))
    w = Window.partitionBy("stream_id").orderBy("block_no")
    heads = blocks.withColumn("head", F.substr("data", F.lit(1), F.lit(overlap)))
    count = -(-overlap // max(1, shortest or 1))
    if count == 1:
        following: Column = F.coalesce(F.lead("head", 1).over(w), F.lit(b""))
    else:
        rest = F.collect_list("head").over(w.rowsBetween(1, count))
        following = F.aggregate(rest, F.lit(b""), lambda acc, x: F.substr(F.concat(acc, x), F.lit(1), F.lit(overlap)))
    return heads.withColumn("next_head", following).drop("head")


def reassemble(blocks: DataFrame) -> DataFrame:
    """(stream_id, data) of whole streams; a stream must fit in a row."""
    parts = blocks.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "data"))).alias("parts"))
    return parts.select("stream_id", _joined(F.transform("parts", lambda p: p["data"])).alias("data"))


def _joined(parts) -> Column:
    return F.unhex(F.array_join(F.transform(parts, lambda d: F.hex(d)), ""))


def totals(blocks: DataFrame) -> DataFrame:
    """(stream_id, blocks, total_len, longest): a row for each stream."""
    return blocks.groupBy("stream_id").agg(F.count("*").alias("blocks"), F.sum("block_len").alias("total_len"), F.max("block_len").alias("longest"))


def check_lengths(blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """Streams whose blocks don't add up to the declared total_len: (stream_id, total_len, found)."""
    found = totals(blocks).select("stream_id", F.col("total_len").alias("found"))
    return declared.join(found, "stream_id", "full_outer").where(~F.col("total_len").eqNullSafe(F.coalesce("found", F.lit(0)))).select("stream_id", "total_len", "found")


def concatenated(*tables: DataFrame) -> DataFrame:
    """Block tables one after the other; ids must differ between them. No match or window crosses from one stream to the next."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def byte_values(blocks: DataFrame) -> DataFrame:
    """(stream_id, offset, value): every byte as a row."""
    rows = blocks.select("stream_id", "block_start", F.posexplode(F.split(F.regexp_replace(F.hex("data"), "(..)", "$1 "), " ")).alias("i", "h")).where("h <> ''")
    return rows.select("stream_id", (F.col("block_start") + F.col("i")).alias("offset"), F.conv("h", 16, 10).cast("int").alias("value"))
