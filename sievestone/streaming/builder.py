"""An incremental block builder: pieces of streams arrive in order, blocks of a fixed size leave as soon as they are complete.

The state of a stream is its unfinished tail, less than a block plus overlap; it doesn't grow with the stream. A block waits for the
`overlap` bytes behind it, which its search table needs. A flush emits what is there as a short block that has no
full overlap, so it gets no table and is always scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BLOCKS = "stream_id long, block_no int, block_start long, block_len int, data binary, next_head binary, has_overlap boolean"
STATE = "tail binary, start long, block_no int"


class BlockBuilder(StatefulProcessor):
    """Input: (stream_id, seq, data, flush); rows of a stream are taken in order of seq, within a batch."""

    def __init__(self, block_size: int, overlap: int):
        self.block_size, self.overlap = block_size, overlap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rest", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail, start, no = (bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in self.state.get()) if self.state.exists() else (b"", 0, 0)
        out = []
        pieces = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for data, flush in zip(pieces["data"], pieces["flush"], strict=True):
            tail += bytes(data) if data is not None else b""
            at = 0
            while len(tail) - at >= self.block_size + self.overlap:
                out.append(self.block(key[0], no, start, tail, at, self.block_size))
                at, start, no = at + self.block_size, start + self.block_size, no + 1
            tail = tail[at:]
            while flush and tail:
                size = min(self.block_size, len(tail))
                out.append(self.block(key[0], no, start, tail, 0, size))
                tail, start, no = tail[size:], start + size, no + 1
        self.state.update((tail, start, no))
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "block_no", "block_start", "block_len", "data", "next_head", "has_overlap"])

    def block(self, stream, no, start, tail, at, size):
        head = tail[at + size : at + size + self.overlap]
        return stream, no, start, size, tail[at : at + size], head, len(head) >= self.overlap

    def close(self) -> None:
        pass


def build_blocks(pieces: DataFrame, block_size: int, overlap: int = 0) -> DataFrame:
    """Blocks of a streaming (stream_id, seq, data, flush). flush: end the block there; the last piece of a stream needs one.

    Sets the session's state store to RocksDB, the only one that Spark allows for this kind of state.
    """
    pieces.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = pieces.select(F.col("stream_id").cast("long").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.col("data").cast("binary").alias("data"), F.coalesce(F.col("flush"), F.lit(False)).alias("flush"))
    return rows.groupBy("stream_id").transformWithStateInPandas(BlockBuilder(block_size, overlap), outputStructType=BLOCKS, outputMode="Append", timeMode="None")


def flush_each(pieces: DataFrame) -> DataFrame:
    """Each piece ends a block: what is written is visible at once, in short blocks."""
    return pieces.withColumn("flush", F.lit(True))
