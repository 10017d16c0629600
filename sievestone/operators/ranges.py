"""Range reads over block tables: offset, limit, tail, newline alignment; and the seek index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import parse_size

NEWLINE = b"\n"


def option(text: str) -> tuple[int, bool]:
    """'64KB+nl' as (bytes, aligned to a newline)."""
    size, plus, rest = text.partition("+")
    if plus and rest != "nl":
        raise ValueError(f"not a range option: {text!r}")
    return parse_size(size), bool(plus)


def check_options(offset=None, tail=None, limit=None, follow: bool = False, seekable: bool = True) -> None:
    if offset is not None and tail is not None:
        raise ValueError("either offset or tail")
    if follow and (tail is not None or limit is not None):
        raise ValueError("follow has no tail or limit")
    if not seekable and (offset is not None or tail is not None):
        raise ValueError("this source can't be read from the middle")


def _joined(parts: str) -> Column:
    return F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), ""))


def read_range(blocks: DataFrame, offset: int | Column, length: int | Column | None = None) -> DataFrame:
    """(stream_id, data): bytes from offset on, at most length. Blocks outside are dropped by their bounds before anything is joined."""
    lo = F.lit(offset) if isinstance(offset, int) else offset
    hi = F.lit(1 << 62) if length is None else lo + length
    end = F.col("block_start") + F.col("block_len")
    near = blocks.where((F.col("block_start") < hi) & (end > lo))
    first = F.greatest(F.lit(0), lo - F.col("block_start"))
    size = F.least(end, hi) - F.col("block_start") - first
    part = near.select("stream_id", F.struct("block_no", F.hex(F.substr("data", (first + 1).cast("int"), size.cast("int"))).alias("h")).alias("p"))
    return part.groupBy("stream_id").agg(F.array_sort(F.collect_list("p")).alias("parts")).select("stream_id", _joined("parts").alias("data"))


def _newlines(blocks: DataFrame, after: DataFrame) -> DataFrame:
    """(stream_id, nl): the place of the first newline at or behind `at` of (stream_id, at). Each block is looked at by itself."""
    near = blocks.join(after, "stream_id").where(F.col("block_start") + F.col("block_len") > F.col("at"))
    skip = F.greatest(F.lit(0), F.col("at") - F.col("block_start"))
    # One character for each byte.
    found = F.instr(F.decode(F.substr("data", (skip + 1).cast("int"), F.col("block_len")), "ISO-8859-1"), "\n")
    return near.select("stream_id", F.when(found > 0, F.col("block_start") + skip + found - 1).alias("nl")).groupBy("stream_id").agg(F.min("nl").alias("nl"))


def _between(blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """(stream_id, data): the bytes from lo to hi (exclusive, null: the end) of each row of bounds (stream_id, lo, hi); empty where there are none."""
    end = F.col("block_start") + F.col("block_len")
    hi = F.coalesce("hi", F.lit(1 << 62))
    near = blocks.join(bounds, "stream_id").where((F.col("block_start") < hi) & (end > F.col("lo")))
    first = F.greatest(F.lit(0), F.col("lo") - F.col("block_start"))
    size = F.least(end, hi) - F.col("block_start") - first
    part = near.select("stream_id", F.struct("block_no", F.hex(F.substr("data", (first + 1).cast("int"), size.cast("int"))).alias("h")).alias("p"))
    read = part.groupBy("stream_id").agg(F.array_sort(F.collect_list("p")).alias("parts")).select("stream_id", _joined("parts").alias("data"))
    return bounds.select("stream_id").join(read, "stream_id", "left").select("stream_id", F.coalesce("data", F.lit(b"")).alias("data"))


def read_from(blocks: DataFrame, offset: int, limit: int | None = None, offset_nl: bool = False, limit_nl: bool = False) -> DataFrame:
    """read_range() with alignment: offset_nl starts after the next newline (or where it was, if none follows);
    limit_nl goes on after `limit` bytes up to the next newline, which is left out.

    Newlines are looked for in each block; of a stream, only the blocks of the result meet in a row.
    """
    if not offset_nl and not limit_nl:
        return read_range(blocks, offset, limit)
    bounds = blocks.where(F.col("block_start") + F.col("block_len") > offset).groupBy("stream_id").agg(F.lit(offset).cast("long").alias("at"))
    bounds = bounds.withColumnRenamed("at", "lo")
    if offset_nl:
        met = bounds.join(_newlines(blocks, bounds.withColumnRenamed("lo", "at")), "stream_id", "left")
        bounds = met.select("stream_id", F.coalesce(F.col("nl") + 1, "lo").alias("lo"))
    bounds = bounds.withColumn("hi", F.lit(None).cast("long") if limit is None else F.col("lo") + limit)
    if limit_nl and limit is not None:
        met = bounds.join(_newlines(blocks, bounds.select("stream_id", F.col("hi").alias("at"))), "stream_id", "left")
        bounds = met.select("stream_id", "lo", F.col("nl").alias("hi"))
    return _between(blocks, bounds)


def tail(blocks: DataFrame, n: int, nl: bool = False, limit: int | None = None) -> DataFrame:
    """The last n bytes of each stream (all of a shorter one), at most `limit` of them; nl: from the next newline on."""
    total = blocks.groupBy("stream_id").agg(F.max(F.col("block_start") + F.col("block_len")).alias("total"))
    bounds = total.select("stream_id", F.greatest(F.lit(0), F.col("total") - n).alias("lo"))
    if nl:
        met = bounds.join(_newlines(blocks, bounds.withColumnRenamed("lo", "at")), "stream_id", "left")
        bounds = met.select("stream_id", F.coalesce(F.col("nl") + 1, "lo").alias("lo"))
    return _between(blocks, bounds.withColumn("hi", F.lit(None).cast("long") if limit is None else F.col("lo") + limit))


def read_byte(blocks: DataFrame, offset: int) -> DataFrame:
    """(stream_id, value): one byte, of streams that reach so far."""
    near = blocks.where((F.col("block_start") <= offset) & (F.col("block_start") + F.col("block_len") > offset))
    at = (F.lit(offset + 1) - F.col("block_start")).cast("int")
    return near.select("stream_id", F.conv(F.hex(F.substr("data", at, F.lit(1))), 16, 10).cast("int").alias("value"))


def seek_index(blocks: DataFrame, stored_len: str | Column = "block_len") -> DataFrame:
    """(stream_id, entry_no, compressed_offset, uncompressed_offset): running sums over the blocks; stored_len is a block's size as kept."""
    w = Window.partitionBy("stream_id").orderBy("block_no")
    stored = F.col(stored_len) if isinstance(stored_len, str) else stored_len
    sized = blocks.select("stream_id", "block_no", "block_start", stored.cast("long").alias("stored"))
    before = F.coalesce(F.sum("stored").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.select("stream_id", (F.row_number().over(w) - 1).alias("entry_no"), before.alias("compressed_offset"), F.col("block_start").alias("uncompressed_offset"))


def thin_index(index: DataFrame, least: int) -> DataFrame:
    """Entries at least `least` uncompressed bytes after the last kept one; the first always stays. One fold over each stream's entries."""
    each = index.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("uncompressed_offset", "compressed_offset"))).alias("all"))
    kind = each.schema["all"].dataType.simpleString()
    kept = F.aggregate("all", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) == 0) | (x["uncompressed_offset"] >= F.element_at(acc, -1)["uncompressed_offset"] + least), F.concat(acc, F.array(x))).otherwise(acc))
    rows = each.select("stream_id", F.posexplode(kept).alias("entry_no", "e"))
    return rows.select("stream_id", "entry_no", "e.compressed_offset", "e.uncompressed_offset")


def find(index: DataFrame, offsets: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """offsets (stream_id, offset) with the last entry at or before each. Negative offsets count from the end and need `total`
    (stream_id, total_len); an offset past the end has null entries."""
    want = offsets.select("stream_id", "offset", F.col("offset").alias("at"))
    if total is not None:
        want = offsets.join(total.select("stream_id", "total_len"), "stream_id", "left")
        at = F.when(F.col("offset") < 0, F.col("offset") + F.col("total_len")).otherwise(F.col("offset"))
        want = want.select("stream_id", "offset", F.when((at >= 0) & (at <= F.col("total_len")), at).alias("at"))
    # One sorted pass over entries and offsets together: the last entry seen so far.
    entries = index.select("stream_id", F.col("uncompressed_offset").alias("at"), F.lit(0).alias("kind"), F.struct("compressed_offset", "uncompressed_offset").alias("e"), F.lit(None).cast("long").alias("offset"))
    asked = want.select("stream_id", "at", F.lit(1).alias("kind"), F.lit(None).cast(entries.schema["e"].dataType).alias("e"), "offset")
    w = Window.partitionBy("stream_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    floor = entries.unionByName(asked).withColumn("e", F.when(F.col("at").isNotNull(), F.last("e", ignorenulls=True).over(w))).where("kind = 1")
    return floor.select("stream_id", "offset", "e.compressed_offset", "e.uncompressed_offset")


def index_json(index: DataFrame, total: DataFrame) -> DataFrame:
    """(stream_id, json): sizes, an estimated block size and all offsets of each stream."""
    pairs = index.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("uncompressed_offset", "compressed_offset"))).alias("offsets"))
    met = pairs.join(total, "stream_id")
    doc = F.struct(F.col("total_len").alias("total_uncompressed"), F.floor(F.col("total_len") / F.size("offsets")).alias("est_block_uncompressed"), F.transform("offsets", lambda o: F.struct(o["compressed_offset"].alias("compressed"), o["uncompressed_offset"].alias("uncompressed"))).alias("offsets"))
    return met.select("stream_id", F.to_json(doc).alias("json"))
