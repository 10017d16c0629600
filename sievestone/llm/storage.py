"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own if Spark runs in this process alone, else an error."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="sievestone-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table to the shared folder and read again: lineage ends here and lost executors cost nothing.

    Shuffle files are deleted as soon as the table is written, where Spark can do that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if before is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    spark._jvm.System.gc()  # broadcasts that nothing refers to any more go from the executors
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete the files of a table that saved() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch that goes to a Python worker; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: batches end at BATCH_BYTES as well as at a number of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Ids that are broadcast at most (8 bytes each); more are joined by shuffle.
IDS_MOST = 1 << 18


def with_ids(rows: DataFrame, ids: DataFrame, how: str, id_col: str = "id") -> DataFrame:
    """left_semi or left_anti join of rows with ids (a column id), which are counted first."""
    few = ids.limit(IDS_MOST + 1).count() <= IDS_MOST
    return rows.join(F.broadcast(ids) if few else ids, rows[id_col].cast("long") == ids["id"], how)
