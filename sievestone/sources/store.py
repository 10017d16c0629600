"""A stored block table: streams, blocks, search tables and the seek index as Parquet data sets in one folder.

Blocks are dealt to parts by ranges of stream and place; a part is a folder with one file. A search goes by the tables and the blocks'
keys alone (no bytes are read for that), and opens only the parts that have a block left.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import SearchConfig, checked
from ..operators import blocks as b
from ..operators import index, ranges, search
from ..plans.pruning import candidates

CODECS = ("uncompressed", "snappy", "lz4_raw", "zstd", "gzip")
CONFIG = "config_id int, table_type int, match_len int, base_log2 int, extras int, prefix_set binary, long_prefix binary, max_pop int, max_reduced_pop int"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own if Spark runs in this process alone, else an error."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="sievestone-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def config_rows(spark: SparkSession, configs: Sequence[SearchConfig]) -> DataFrame:
    rows = [(c.config_id, c.table_type, c.match_len, c.base_log2, c.extras, c.prefixes, c.long_prefix, c.max_pop, c.max_reduced_pop) for c in configs]
    return spark.createDataFrame(rows, CONFIG)


def read_configs(df: DataFrame) -> list[SearchConfig]:
    return [SearchConfig(r.match_len, bytes(r.prefix_set), bytes(r.long_prefix), r.extras, r.base_log2, r.max_pop, r.max_reduced_pop, r.config_id) for r in df.collect()]  # a row for each configuration


def write_store(streams: DataFrame, path: str, block_size: int = b.DEFAULT_BLOCK, configs: Sequence[SearchConfig] = (), codec: str = "zstd", parts: int | None = None, max_pattern: int = 256, mode: str = "errorifexists") -> None:
    """Cut streams into blocks and write them with their tables.

    Blocks are sorted by stream and place, so that range reads touch few row groups; next_head is stored with each block, so that searches
    for up to max_pattern bytes need no other block. Tables are a data set of their own: a search reads them first. parts: folders that
    the blocks are dealt to, what a search can skip; as many as shuffle partitions unless said otherwise.
    """
    if codec not in CODECS:
        raise ValueError(f"codec is one of {CODECS}")
    spark = streams.sparkSession
    overlap = max([max_pattern - 1, *(c.overlap for c in configs)])
    cut = b.cut(streams, block_size, overlap)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.repartitionByRange(parts, "stream_id", "block_no").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "stream_id", "block_no")
    dealt.write.mode(mode).option("compression", codec).partitionBy("part").parquet(f"{path}/blocks")
    stored = _blocks(spark, path).drop("part")
    spark.createDataFrame([(block_size, overlap, codec)], "block_size int, overlap int, codec string").write.mode(mode).parquet(f"{path}/format")
    ranges.seek_index(stored).write.mode(mode).parquet(f"{path}/seek_index")
    config_rows(spark, configs).write.mode(mode).parquet(f"{path}/configs")
    if configs:
        index.build_tables(stored, configs, block_size).write.mode(mode).option("compression", "zstd").parquet(f"{path}/tables")


def add_tables(spark: SparkSession, path: str, configs: Sequence[SearchConfig], sidecar: str | None = None) -> None:
    """Build tables for a store that is there, into it or into a folder of their own."""
    store = Store(spark, path)
    to = sidecar or path
    if max(c.overlap for c in configs) > store.overlap:
        raise ValueError("the store keeps fewer following bytes than these configurations need")
    config_rows(spark, configs).write.mode("overwrite").parquet(f"{to}/configs")
    index.build_tables(store.blocks, configs, store.block_size).write.mode("overwrite").option("compression", "zstd").parquet(f"{to}/tables")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """All blocks, with their part; a store of empty streams has none."""
    kinds = "stream_id long, block_no int, block_start long, block_len int, data binary, is_last boolean, next_head binary, part int"
    return spark.read.schema(kinds).parquet(f"{path}/blocks")


class Store:
    """A stored block table. sidecar: a folder with tables to go by instead of the store's own."""

    def __init__(self, spark: SparkSession, path: str, sidecar: str | None = None):
        self.spark, self.path, self.side = spark, path.rstrip("/"), (sidecar or path).rstrip("/")
        head = spark.read.parquet(f"{self.path}/format").first()
        self.block_size, self.overlap = head.block_size, head.overlap
        self.configs = read_configs(spark.read.parquet(f"{self.side}/configs"))

    @property
    def blocks(self) -> DataFrame:
        return _blocks(self.spark, self.path).drop("part")

    @property
    def tables(self) -> DataFrame | None:
        return self.spark.read.schema(index.TABLES).parquet(f"{self.side}/tables") if self.configs else None

    @property
    def seek_index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/seek_index")

    def _open_keys(self, pattern: bytes | str, bail: bool) -> DataFrame:
        """(stream_id, block_no, part) of the blocks that the tables don't rule out; reads tables and keys, no bytes."""
        tables = self.tables if self.configs else self.spark.createDataFrame([], index.TABLES)
        return candidates(_blocks(self.spark, self.path).select("stream_id", "block_no", "part"), tables, self.configs, pattern, self.block_size, bail)

    def candidates(self, pattern: bytes | str, bail: bool = False) -> DataFrame:
        """Blocks of the parts that have a block left: those blocks, and what else is in these files. A number for each file is collected."""
        if not self.configs and not bail:
            return self.blocks
        parts = sorted(r.part for r in self._open_keys(pattern, bail).select("part").distinct().collect())
        if not parts:
            return self.blocks.limit(0)
        return self._of_parts(parts)

    def _of_parts(self, parts: list[int]) -> DataFrame:
        kinds = _blocks(self.spark, self.path).schema
        return self.spark.read.schema(kinds).option("basePath", f"{self.path}/blocks").parquet(*[f"{self.path}/blocks/part={k}" for k in parts]).drop("part")

    def search(self, pattern: bytes | str, bail: bool = False) -> DataFrame:
        pattern = checked(pattern)
        if len(pattern) - 1 > self.overlap:
            # Longer than what is stored behind a block: a stream's later blocks are needed with the parts'.
            whole = b.with_next_head(self.blocks.drop("next_head"), len(pattern) - 1, self.block_size)
            return search.scan(whole.join(self._open_keys(pattern, bail).select("stream_id", "block_no"), ["stream_id", "block_no"], "left_semi"), pattern)
        return search.scan(self.candidates(pattern, bail), pattern)

    def stats(self, pattern: bytes | str) -> DataFrame:
        """search_stats() of the blocks' keys and lengths, without their bytes."""
        return search.search_stats(self.blocks.select("stream_id", "block_no", "block_len"), self.tables, self.configs, pattern, self.block_size)

    def read(self, offset: int = 0, limit: int | None = None, **aligned) -> DataFrame:
        return ranges.read_from(self.blocks, offset, limit, **aligned)

    def tail(self, n: int, nl: bool = False, limit: int | None = None) -> DataFrame:
        return ranges.tail(self.blocks, n, nl, limit)

    def verify(self) -> DataFrame:
        """(stream_id, blocks, gaps): streams whose blocks don't follow each other without gaps up to a last one."""
        b_ = self.blocks.groupBy("stream_id").agg(F.count("*").alias("blocks"), F.sum("block_len").alias("bytes"), F.max(F.col("block_start") + F.col("block_len")).alias("end"), F.count_if("is_last").alias("lasts"), F.count_if(F.length("data") != F.col("block_len")).alias("wrong"))
        return b_.where("bytes <> end OR lasts <> 1 OR wrong > 0").select("stream_id", "blocks", (F.col("end") - F.col("bytes")).alias("gaps"))


def rewrite(spark: SparkSession, path: str, to: str, block_size: int | None = None, codec: str = "zstd", configs: Sequence[SearchConfig] | None = None) -> None:
    """A store once more, with another block size, codec or other tables."""
    old = Store(spark, path)
    write_store(b.reassemble(old.blocks), to, block_size or old.block_size, old.configs if configs is None else configs, codec)


def files(spark: SparkSession, *paths: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(stream_id, source, data) of whole files, one stream each; ids are hashes of the path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(list(paths)).select(F.xxhash64("path").alias("stream_id"), F.col("path").alias("source"), F.col("content").alias("data"))


def sniff(df: DataFrame) -> DataFrame:
    """df (with data) and `kind`: by the first byte, 'stream' (ff), 'block' (00), 'empty' or 'raw'."""
    first = F.hex(F.substr("data", F.lit(1), F.lit(1)))
    return df.withColumn("kind", F.when(F.length("data") == 0, "empty").when(first == "FF", "stream").when(first == "00", "block").otherwise("raw"))
