"""Tables written once to the shared folder and read again, where a plan would compute them several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or temporary if Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/foliant-{uuid.uuid4().hex}"


def once(df: DataFrame, *folders: str) -> DataFrame:
    """df as Parquet in the shared folder: read however often, computed once, whatever executors are lost.

    Runs when it is called, so an operator that stages costs its work where it is built. The folder is the
    session's: it goes with spark.checkpoint.dir, or, if that is unset, with the temporary folder. With
    folders, columns of few values that come last in df, a reader of one value opens that value's files only.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path, partitionBy=list(folders) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into as many partitions as shuffles have: few bytes, much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def holds_files(spark: SparkSession, pattern: str) -> bool:
    """Whether any file matches the pattern, in any store that Spark can open."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))
