"""Lines of text streams and grep-style results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import checked


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(stream_id, line_no, line_start, line_end, line): line_no from 1; bytes, line_end without the newline.

    What follows the last newline is a line, if it isn't empty. Starts are running sums inside each text's own array.
    """
    parts = df.select(F.col(id_col).cast("long").alias("stream_id"), F.split(F.col(text_col).cast("string"), "\n").alias("parts"))
    sized = parts.select("stream_id", "parts", F.transform("parts", lambda x: F.octet_length(x).cast("long") + 1).alias("sizes"))
    rows = sized.select("stream_id", F.posexplode("parts").alias("i", "line"), F.size("parts").alias("n"))
    w = Window.partitionBy("stream_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("line").cast("long")
    rows = rows.withColumn("line_start", F.coalesce(F.sum(size + 1).over(w), F.lit(0)))
    kept = rows.where((F.col("i") < F.col("n") - 1) | (F.col("line") != ""))
    return kept.select("stream_id", (F.col("i") + 1).alias("line_no"), "line_start", (F.col("line_start") + size).alias("line_end"), "line")


def matching_lines(df: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """Lines that hold the pattern, each once; with match_ordinal, its number among them in the stream.

    A text without the pattern is dropped before it is split. A pattern with a newline matches no line.
    """
    needle = checked(pattern).decode()
    near = df.where(F.contains(F.col(text_col).cast("string"), F.lit(needle)))
    hit = lines(near, id_col, text_col).where(F.contains("line", F.lit(needle)))
    return hit.withColumn("match_ordinal", F.row_number().over(Window.partitionBy("stream_id").orderBy("line_no")))


def lines_of_matches(matches: DataFrame, lines_: DataFrame) -> DataFrame:
    """The line each match starts in, once for all matches of a line: first_offset, matches."""
    met = matches.join(lines_, "stream_id").where((F.col("stream_offset") >= F.col("line_start")) & (F.col("stream_offset") <= F.col("line_end")))
    return met.groupBy("stream_id", "line_no", "line_start", "line_end", "line").agg(F.min("stream_offset").alias("first_offset"), F.count("*").alias("matches"))


def occurrences(df: DataFrame, id_col: str, text_col: str, pattern: str, overlapping: bool = True) -> DataFrame:
    """(stream_id, n): how often the pattern occurs in each text that has it. Overlapping ones count unless told otherwise."""
    needle = checked(pattern).decode()
    quoted = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    near = df.where(F.contains(F.col(text_col).cast("string"), F.lit(needle)))
    n = F.regexp_count(F.col(text_col), F.lit(f"(?={quoted})" if overlapping else quoted))
    return near.select(F.col(id_col).cast("long").alias("stream_id"), n.cast("long").alias("n"))
