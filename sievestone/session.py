"""Session settings for large inputs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sievestone", **settings) -> SparkSession:
    """A session with adaptive execution; settings take precedence (a_b_c for a.b.c)."""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    conf |= {k.replace("_", "."): str(v) for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()


#: Bytes of an Arrow batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: batches end at BATCH_BYTES as well as at a number of rows, however long the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
