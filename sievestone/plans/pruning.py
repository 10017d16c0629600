"""Pruning: candidate blocks of a pattern, from search tables alone.

A match belongs to the block it starts in. A block is ruled out if some window of the pattern is in neither its own table nor those of the
following blocks that a match could reach into; or if a window that its own table would have for sure isn't there. A missing table holds everything; each table is probed with its own
number of foldings. Of several configurations any proof counts. No byte of any block is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import SearchConfig, checked
from ..functions.scalar import auto_table_log2
from ..operators.index import slot_of


class SearchTablesUnusable(Exception):
    """A search that must not read whole inputs has no table to go by."""


def usable_configs(configs: Sequence[SearchConfig], pattern: bytes) -> list[SearchConfig]:
    return [c for c in configs if c.usable(pattern)]


def has_slot(slot: int) -> Column:
    """Whether a table row's bitmap has the slot's bit."""
    at = f"({slot}L & (total_bits - 1))"
    byte = f"cast(conv(hex(substring(bitmap, cast(shiftright({at}, 3) AS int) + 1, 1)), 16, 10) AS int)"
    return F.expr(f"(shiftright({byte}, cast({at} & 7 AS int)) & 1) = 1")


def probe(tables: DataFrame, config: SearchConfig, pattern: bytes, block_size: int) -> DataFrame:
    """(stream_id, block_no, hits, own, empty, has_overlap): for each window of the pattern whether the table has it; own: whether
    it has all that its block must have if the pattern starts there. Both null for a table built without the bytes that follow."""
    base = config.base_log2 or auto_table_log2(block_size)
    slots = sorted({slot_of(w, base) for _, w in config.windows(pattern)})
    hits = F.array(*[has_slot(s) for s in slots]) if slots else F.array().cast("array<boolean>")
    own = reduce(Column.__and__, [has_slot(s) for s in sorted({slot_of(w, base) for w in config.own_windows(pattern)})], F.lit(True))
    return tables.where(F.col("config_id") == config.config_id).select("stream_id", "block_no", F.when(F.col("has_overlap"), hits).alias("hits"), F.when(F.col("has_overlap"), own).alias("own"), (F.col("popcount") == 0).alias("empty"), "has_overlap")


def proofs(blocks: DataFrame, tables: DataFrame, config: SearchConfig, pattern: bytes, block_size: int, shortest: int | None = None) -> DataFrame:
    """(stream_id, block_no) of blocks that one configuration rules out. blocks: (stream_id, block_no) at least.

    shortest: the least length of all blocks but each stream's last, block_size unless said otherwise.
    """
    reach = -(-(len(pattern) - 1) // (shortest or block_size)) if len(pattern) > 1 else 0
    met = blocks.select("stream_id", "block_no").join(probe(tables, config, pattern, block_size), ["stream_id", "block_no"], "left")
    w = Window.partitionBy("stream_id").orderBy("block_no").rowsBetween(0, reach)
    seen = F.collect_list(F.struct("hits", "empty", "has_overlap")).over(w)
    rows = met.withColumn("seen", seen)
    if config.prefix_only(pattern):
        proof = F.forall("seen", lambda t: F.coalesce(t["empty"] & t["has_overlap"], F.lit(False)))
    else:
        n = len({w_ for _, w_ in config.windows(pattern)})
        known = F.forall("seen", lambda t: t["hits"].isNotNull())
        proof = known & F.exists(F.sequence(F.lit(1), F.size(F.col("hits"))), lambda i: F.forall("seen", lambda t: ~F.element_at(t["hits"], i))) if n else F.lit(False)
        proof = proof | (F.col("own") == F.lit(False))
    return rows.where(F.coalesce(proof, F.lit(False))).select("stream_id", "block_no")


def ruled_out(blocks: DataFrame, tables: DataFrame, configs: Sequence[SearchConfig], pattern: bytes, block_size: int, shortest: int | None = None) -> DataFrame:
    """(stream_id, block_no) of blocks that any usable configuration rules out."""
    parts = [proofs(blocks, tables, c, pattern, block_size, shortest) for c in usable_configs(configs, pattern)]
    if not parts:
        return blocks.select("stream_id", "block_no").limit(0)
    return reduce(DataFrame.unionByName, parts).distinct()


def candidates(blocks: DataFrame, tables: DataFrame, configs: Sequence[SearchConfig] | SearchConfig, pattern: bytes | str, block_size: int, bail: bool = False, shortest: int | None = None) -> DataFrame:
    """The blocks, all columns, that may hold a match's start.

    bail: raise SearchTablesUnusable if no configuration can be used or a block has no table, rather than read all.
    """
    pattern = checked(pattern)
    configs = [configs] if isinstance(configs, SearchConfig) else list(configs)
    if bail:
        if not usable_configs(configs, pattern):
            raise SearchTablesUnusable("no configuration indexes a window of this pattern")
        if not blocks.join(tables, ["stream_id", "block_no"], "left_anti").isEmpty():
            raise SearchTablesUnusable("some blocks have no table")
    return blocks.join(ruled_out(blocks, tables, configs, pattern, block_size, shortest), ["stream_id", "block_no"], "left_anti")
