"""A corpus from raw documents: toxic texts go, one of each group of near copies stays, benchmark passages go, sources are mixed, rows are sharded.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; between stages the rows are
written as Parquet and read again. All but the last return the columns of documents, and any more that they are given, as they are: no
stage looks at other columns than doc_id, text and source, whatever the rest is called. Empty tables give empty tables. Repeated rows
are rows: each is scored, tiled, mixed and sharded by itself; only the second stage keeps one of them. Null and empty texts, and null
ids, go through all stages; a text is read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievestone.llm import mixing, tiling, toxicity
from sievestone.llm.jaccard_join import one_of_each_group
from sievestone.llm.sharding import shard
from sievestone.llm.storage import saved, small_batches


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5. Null and empty texts have the score of a text that no voter speaks on."""
    small_batches(spark)
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, scorer)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of shingle Jaccard 0.8 or more join, the one with the least id.

    Texts without words (null, empty, blank) and rows with a null id are in no group and stay.
    """
    return one_of_each_group(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Null and empty texts and passages hold and match nothing."""
    small_batches(spark)
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Texts without words are of size 0 and stay as often as their source's rate, rounded down,
    says; a null source is a source."""
    return mixing.take_mix(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of each row. A null text has no bytes; null ids come first."""
    return shard(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", remove_near_copies),
    ("benchmark_decontamination", remove_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", cut_shards),
]

#: Learned scores and hashed coins have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
