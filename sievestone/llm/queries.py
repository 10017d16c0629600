"""The registered queries of this package: name -> function of (spark, sf_dir), and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard_join import jaccard_components
from .licenses import DICE, TEMPLATES, bigrams, normalised_words, scan_licenses
from .line_dedup import dedup_lines
from .mixing import mix
from .secrets import secret_digests
from .sharding import SHARDS, shard
from .spotsigs import edit_report
from .storage import small_batches
from .substring_dedup import repeated_passages
from .tiling import tile_passages
from .toxicity import fit, score


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "lines", "dropped_lines", F.sha2(F.col("text").cast("binary"), 256).alias("clean_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secret_digests(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return tile_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scans, op2_line_dedup, op3_toxicity, op4_secret_scans, op5_substring_dedup, op6_sharding, op7_document_fingerprints, op8_source_mixing, op9_benchmark_decontamination, op10_ngram_jaccard_join
    )
}


def _license_sql() -> str:
    known = [(k, name, bigrams(normalised_words(text))) for k, (name, text) in enumerate(TEMPLATES)]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quoted(name)}, [{', '.join(map(quoted, b))}])" for k, name, b in known)
    return f"""
    WITH templates(template, license, theirs) AS (VALUES {values}),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
    w AS (SELECT doc_id, line_no, list_filter(list_transform(string_split(regexp_replace(
          translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2D\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: trim(x, '.')), lambda x: x <> '') AS w FROM lines),
    b AS (SELECT doc_id, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM w WHERE len(w) > 1),
    s AS (SELECT doc_id, line_no, license, template, 2.0::DOUBLE * len(list_intersect(own, theirs)) / (len(own) + len(theirs)) AS dice FROM b, templates),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, template) AS k FROM s WHERE dice >= {DICE})
    SELECT doc_id, line_no, license, template, dice FROM r WHERE k = 1"""


ORACLES: dict[str, str] = {"op1_license_scans": _license_sql()}
