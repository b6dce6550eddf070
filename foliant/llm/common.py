"""What several operators share: staged tables, words, let-bindings, prefix sums over blocks."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Rows of a batch whose values are computed together.
STEP = 1000

#: White space between words, as in the class [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as the cluster names it.

    Only a local session without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/foliant-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again.

    Cuts the lineage: what follows neither recomputes df nor loses it with an executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Remove this application's staged tables; results not yet computed from them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hash_sample(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """The n rows of df, which has total, whose hash of key is least.

    Rows are dropped by the hash before they are ordered, so few reach the one task that counts them
    out; a handful may be missing at the end.
    """
    h = F.xxhash64(key)
    share = min(1.0, (n + 6 * n**0.5 + 20) / max(total, 1))
    return df.where(F.pmod(h, F.lit(1 << 40)) <= int(share * (1 << 40))).orderBy(F.pmod(h, F.lit(1 << 40)), key).limit(n)


def per_worker(kind: str, key: str, make: Callable[[], Any]) -> Any:
    """make(), once for each Python worker and key; a worker keeps the last object of each kind.

    For what is costly to build and doesn't change, such as a tokenizer and the words it has seen.
    """
    kept = sys.modules.setdefault("foliant_worker", types.ModuleType("foliant_worker")).__dict__
    if kept.get(kind, (None,))[0] != key:
        kept[kind] = (key, make())
    return kept[kind][1]


def with_values(rows: DataFrame, keep: list[str], start: Callable[[], Callable[[list], list[pa.Array]]], added: str, source: str = "text") -> DataFrame:
    """keep of every row and the columns declared in added: what start()'s function makes of a list of source.

    start() is called once a task. The columns of keep pass by as Arrow arrays, so ids that are null
    or beyond 2^53, decimals, timestamps, structs and maps come back as they were.
    """
    new = StructType.fromDDL(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                some = b.slice(at, STEP)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), *make(some.column(source).to_pylist())], names=[*keep, *new.names])

    schema = StructType([*(rows.schema[c] for c in keep), *new])
    return rows.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, source]))).mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The maximal runs of other than BLANKS; an empty array for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def block_offsets(df: DataFrame, block: str, keys: list[str], amount: Column, name: str) -> DataFrame:
    """For each (block, keys): the sum of amount over all earlier blocks with the same keys.

    df is aggregated first, so the window sees one row for each block and key.
    """
    sums = df.groupBy(block, *keys).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(block, *keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias(name))
