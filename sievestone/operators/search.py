"""Exact byte search: every occurrence of a literal pattern, overlapping ones and those across blocks included."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import SearchConfig, checked
from ..plans.pruning import candidates, usable_configs
from ..session import small_batches

MATCHES = "stream_id long, stream_offset long, block_no int, offset_in_block int, straddles boolean"


def _reach(blocks: DataFrame, pattern: bytes):
    """A block's bytes with as many following ones as a match that starts in it can need."""
    return F.concat("data", F.substr("next_head", F.lit(1), F.lit(len(pattern) - 1))) if len(pattern) > 1 else F.col("data")


def scan(blocks: DataFrame, pattern: bytes | str) -> DataFrame:
    """(stream_id, stream_offset, block_no, offset_in_block, straddles) of all occurrences.

    blocks: with next_head of at least len(pattern) - 1 bytes. Blocks without an occurrence are left out inside the JVM; only
    the rest go to Python, in Arrow batches, for the offsets. A match belongs to the block it starts in; the next search
    goes on one byte after each start.
    """
    pattern = checked(pattern)
    near = blocks.select("stream_id", "block_start", "block_no", "block_len", _reach(blocks, pattern).alias("w")).where(F.contains("w", F.lit(pattern)))

    def find(batches):
        for batch in batches:
            rows = []
            for sid, start, no, size, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i = w.find(pattern)
                while 0 <= i < size:
                    rows.append((sid, start + i, no, i, i + len(pattern) > size))
                    i = w.find(pattern, i + 1)
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["stream_id", "stream_offset", "block_no", "offset_in_block", "straddles"])

    small_batches(blocks.sparkSession)
    return near.mapInArrow(find, MATCHES)


def search(blocks: DataFrame, pattern: bytes | str, tables: DataFrame | None = None, configs: Sequence[SearchConfig] | SearchConfig = (), block_size: int | None = None, bail: bool = False, shortest: int | None = None) -> DataFrame:
    """scan() of the blocks that the tables don't rule out; the same rows, whatever the tables.

    Blocks that are not stored have been made, and so read, before the tables can rule them out; what saves reading is Store.search.
    """
    pattern = checked(pattern)
    if tables is not None:
        if block_size is None:
            raise ValueError("block_size is needed with tables")
        blocks = candidates(blocks, tables, configs, pattern, block_size, bail, shortest)
    return scan(blocks, pattern)


def exists(blocks: DataFrame, pattern: bytes | str) -> DataFrame:
    """(found): one row. Reading stops at the first block that has the pattern."""
    pattern = checked(pattern)
    hit = blocks.where(F.contains(_reach(blocks, pattern), F.lit(pattern))).limit(1)
    return hit.agg((F.count("*") > 0).alias("found"))


def streams_with(streams: DataFrame, pattern: bytes | str) -> DataFrame:
    """(stream_id, found) of whole streams; nothing leaves the JVM."""
    return streams.select("stream_id", F.contains("data", F.lit(checked(pattern))).alias("found"))


def count(matches: DataFrame) -> DataFrame:
    """(stream_id, matches)."""
    return matches.groupBy("stream_id").agg(F.count("*").alias("matches"))


def with_context(matches: DataFrame, blocks: DataFrame, before: int, after: int, length: int) -> DataFrame:
    """matches with `context`: the bytes around each, `before` and `after` at most, across blocks and less at a stream's ends.

    Only blocks that a match's context touches are joined, after the search.
    """
    lo, hi = F.greatest(F.lit(0), F.col("stream_offset") - before), F.col("stream_offset") + length + after
    spans = matches.select("*", lo.alias("lo"), hi.alias("hi"))
    size = blocks.agg(F.max("block_len")).first()[0] or 1
    cells = blocks.select("stream_id", "block_start", "block_len", "data", F.explode(F.sequence(F.floor(F.col("block_start") / size), F.floor((F.col("block_start") + F.col("block_len") - 1) / size))).alias("cell"))
    wanted = spans.select("stream_id", "stream_offset", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))).alias("cell"))
    met = wanted.join(cells, ["stream_id", "cell"]).where((F.col("block_start") < F.col("hi")) & (F.col("block_start") + F.col("block_len") > F.col("lo")))
    met = met.dropDuplicates(["stream_id", "stream_offset", "block_start"])
    first = F.greatest(F.lit(0), F.col("lo") - F.col("block_start"))
    part = F.hex(F.substr("data", (first + 1).cast("int"), (F.col("hi") - F.col("block_start") - first).cast("int")))
    joined = met.groupBy("stream_id", "stream_offset").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_start", part.alias("h")))), lambda p: p["h"]), "").alias("h"))
    return matches.join(joined.select("stream_id", "stream_offset", F.unhex("h").alias("context")), ["stream_id", "stream_offset"], "left")


def with_blocks(matches: DataFrame, blocks: DataFrame) -> DataFrame:
    """matches with previous, current and following block; null where a stream begins or ends."""
    own = blocks.select("stream_id", "block_no", F.col("data").alias("block"))
    prev = blocks.select("stream_id", (F.col("block_no") + 1).alias("block_no"), F.col("data").alias("previous_block"))
    after = blocks.select("stream_id", (F.col("block_no") - 1).alias("block_no"), F.col("data").alias("following_block"))
    keys = ["stream_id", "block_no"]
    return matches.join(own, keys).join(prev, keys, "left").join(after, keys, "left")


def pattern_set(streams: DataFrame, patterns: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(stream_id, <id_col>) of each stream and pattern of a small table that it holds; empty and null patterns are left out.

    The patterns are a query set; the smaller side of the nested loop is sent to all tasks by Spark if its size allows.
    """
    p = patterns.select(F.col(id_col), F.encode(F.col(data_col).cast("string"), "UTF-8").alias("p")).where(F.length("p") > 0)
    return streams.join(p, F.contains(F.col("data"), F.col("p"))).select("stream_id", id_col)


def search_stats(blocks: DataFrame, tables: DataFrame, configs: Sequence[SearchConfig] | SearchConfig, pattern: bytes | str, block_size: int, shortest: int | None = None) -> DataFrame:
    """One row on the blocks that the tables rule out ("skipped") and leave, and on the tables themselves. blocks: keys and block_len."""
    pattern = checked(pattern)
    configs = [configs] if isinstance(configs, SearchConfig) else list(configs)
    kept = candidates(blocks, tables, configs, pattern, block_size, shortest=shortest)
    flagged = blocks.select("stream_id", "block_no", "block_len").join(kept.select("stream_id", "block_no", F.lit(True).alias("read")), ["stream_id", "block_no"], "left")
    own = flagged.agg(
        F.count("*").alias("blocks_total"), F.count_if(F.col("read").isNull()).alias("blocks_skipped"), F.count_if("read").alias("blocks_searched"), F.coalesce(F.sum("block_len"), F.lit(0)).alias("bytes_total"), F.coalesce(F.sum(F.when(F.col("read").isNull(), F.col("block_len"))), F.lit(0)).alias("bytes_skipped")
    )
    full = F.col("popcount") * 100.0 / F.col("total_bits")
    tabs = tables.agg(
        F.count("*").alias("tables"), F.coalesce(F.sum(F.length("bitmap")), F.lit(0)).alias("table_bytes"), F.min(full).alias("population_min"), F.max(full).alias("population_max"), F.avg(full).alias("population_avg"), F.avg("reductions").alias("reductions_avg"), F.count_if(~F.col("has_overlap")).alias("without_overlap")
    )
    return own.crossJoin(tabs).withColumn("usable_configs", F.lit(len(usable_configs(configs, pattern))))  # one row each


def window_stats(tables: DataFrame, config: SearchConfig, pattern: bytes | str, block_size: int) -> DataFrame:
    """(win, pos, window, present, absent): for each window of the pattern in how many tables its bit is set."""
    from ..plans.pruning import has_slot
    from .index import slot_of
    from ..functions.scalar import auto_table_log2

    pattern = checked(pattern)
    base = config.base_log2 or auto_table_log2(block_size)
    wins = config.windows(pattern)
    if not wins:
        return tables.sparkSession.createDataFrame([], "win int, pos int, window binary, present long, absent long")
    cells = F.array(*[F.struct(F.lit(k).alias("win"), F.lit(i).alias("pos"), F.lit(w).alias("window"), has_slot(slot_of(w, base)).alias("hit")) for k, (i, w) in enumerate(wins)])
    rows = tables.where(F.col("config_id") == config.config_id).select(F.explode(cells).alias("c"))
    return rows.groupBy("c.win", "c.pos", "c.window").agg(F.count_if("c.hit").alias("present"), F.count_if(~F.col("c.hit")).alias("absent"))


def pattern_windows(spark, config: SearchConfig, pattern: bytes | str) -> DataFrame:
    """(win, pos, window): the windows that the tables are asked for."""
    rows = [(k, i, w) for k, (i, w) in enumerate(config.windows(checked(pattern)))]
    return spark.createDataFrame(rows, "win int, pos int, window binary")
