"""Search tables: a Bloom-style bitmap for each block, over the windows that start in it.

(stream_id, block_no, config_id, reductions, popcount, total_bits, has_overlap, bitmap). A block without a row has no table: it can't be
ruled out. Tables may sit beside the blocks or in a data set of their own; any number of configurations may be built at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import LONG_PREFIX, PLAIN, SearchConfig
from ..functions.scalar import SLOT_HIGH, SLOT_LOW, SLOT_PRIME, auto_table_log2
from ..session import small_batches

TABLES = "stream_id long, block_no int, config_id int, reductions int, popcount int, total_bits int, has_overlap boolean, bitmap binary"
MIN_BYTES = 32


def slots(data: np.ndarray, at: np.ndarray, match_len: int, base_log2: int) -> np.ndarray:
    """Hash slot of the match_len bytes at each place: window_slot() of functions.scalar, over arrays."""
    half = [np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)]
    for k in range(match_len):
        half[k // 4] |= data[at + k].astype(np.uint64) << np.uint64(8 * (k % 4))
    low, high = np.uint64(SLOT_LOW), np.uint64(SLOT_HIGH)
    return (half[0] * low + half[1] * high + np.uint64(match_len)) % np.uint64(SLOT_PRIME) % np.uint64(1 << base_log2)


def slot_of(window: bytes, base_log2: int) -> int:
    raw = np.frombuffer(window, np.uint8)
    return int(slots(raw, np.array([0]), len(raw), base_log2)[0])


def indexed_places(data: np.ndarray, own: int, config: SearchConfig) -> np.ndarray:
    """Where a table's windows start. Plain: in the block. Behind a prefix: where the prefix starts in the block."""
    last = len(data) - config.match_len
    if config.table_type == PLAIN:
        return np.arange(0, min(own, last + 1))
    if config.table_type == LONG_PREFIX:
        raw, found, i = data.tobytes(), [], 0
        while (i := raw.find(config.long_prefix, i)) >= 0 and i < own:
            found.append(i)
            i += 1
        at = np.array(found, np.int64)
        at = (at[:, None] + len(config.long_prefix) + np.arange(config.extras + 1)).ravel() if len(at) else at
        return at[at <= last]
    member = np.zeros(256, bool)
    member[list(config.prefixes)] = True
    at = np.flatnonzero(member[data[:own]]) + 1
    return at[at <= last]


def table_of(data: bytes, next_head: bytes, config: SearchConfig, base_log2: int):
    """(reductions, popcount, total_bits, bitmap), or None if too many bits are set."""
    whole = np.frombuffer(data + next_head[: config.overlap], np.uint8)
    bits = np.zeros(1 << base_log2, bool)
    bits[slots(whole, indexed_places(whole, len(data), config), config.match_len, base_log2).astype(np.int64)] = True
    population = int(bits.sum())
    if population * 100 // len(bits) > config.max_pop:
        return None
    reductions = 0
    while len(bits) // 16 >= MIN_BYTES:
        half = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
        if int(half.sum()) * 100 > len(half) * config.reduced_pop:
            break
        bits, reductions = half, reductions + 1
    return reductions, int(bits.sum()), len(bits), np.packbits(bits, bitorder="little").tobytes()


def build_tables(blocks: DataFrame, configs: Sequence[SearchConfig] | SearchConfig, block_size: int) -> DataFrame:
    """Tables of all blocks under one or more configurations. blocks: with next_head (cut(..., overlap=...)).

    A block of at least `overlap` following bytes, or the last of its stream, has full overlap; each is built alone, with numpy.
    """
    configs = [configs] if isinstance(configs, SearchConfig) else list(configs)
    if not configs or len({c.config_id for c in configs}) < len(configs):
        raise ValueError("at least one configuration, each with its own config_id")
    if "next_head" not in blocks.columns:
        raise ValueError("blocks need next_head: windows that cross into the next block are indexed too")

    def build(batches):
        for batch in batches:
            sid, no, data, head, last = (batch.column(c).to_pylist() for c in range(5))
            rows = []
            for s, k, d, h, is_last in zip(sid, no, data, head, last, strict=True):
                for c in configs:
                    base = c.base_log2 or auto_table_log2(block_size)
                    if (t := table_of(d, h or b"", c, base)) is not None:
                        rows.append((s, k, c.config_id, *t[:3], is_last or len(h or b"") >= c.overlap, t[3]))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["stream_id", "block_no", "config_id", "reductions", "popcount", "total_bits", "has_overlap", "bitmap"])

    small_batches(blocks.sparkSession)
    return blocks.select("stream_id", "block_no", "data", "next_head", "is_last").mapInArrow(build, TABLES)


def extract_tables(blocks_with_tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, blocks without them) of blocks that carry their tables inline as an array column `tables`."""
    side = blocks_with_tables.select("stream_id", "block_no", F.explode("tables").alias("t")).select("stream_id", "block_no", "t.*")
    return side, blocks_with_tables.drop("tables")


def inline_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks with their tables as an array column; blocks without a table have an empty one."""
    kept = ["config_id", "reductions", "popcount", "total_bits", "has_overlap", "bitmap"]
    own = tables.groupBy("stream_id", "block_no").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("tables"))
    return blocks.join(own, ["stream_id", "block_no"], "left").withColumn("tables", F.coalesce("tables", F.array().cast(own.schema["tables"].dataType)))


def exact_windows(blocks: DataFrame, match_len: int) -> DataFrame:
    """(stream_id, block_no, windows): the number of distinct windows of each block, those into the following bytes included."""
    whole = F.concat("data", F.substr("next_head", F.lit(1), F.lit(match_len - 1)))
    places = F.sequence(F.lit(1), F.least(F.col("block_len"), F.length("w") - match_len + 1))
    rows = blocks.select("stream_id", "block_no", "block_len", whole.alias("w"))
    rows = rows.withColumn("windows", F.when(F.length("w") >= match_len, F.size(F.array_distinct(F.transform(places, lambda i: F.hex(F.substr("w", i, F.lit(match_len))))))).otherwise(0))
    return rows.select("stream_id", "block_no", F.col("windows").cast("long").alias("windows"))
