"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Each record goes to the shard with the lowest -ln(u) / weight, where u in (0, 1) is a hash of
the record's key and the shard's name. A shard's draw for a record depends on these two alone,
so a new shard takes records only into itself and a removed one gives up only its own.

Defined results: a null key hashes like any other value (all such records share a shard); a null
text has no bytes and the CRC of the empty string; repeated rows share a shard and get a slot
each; other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import block_offsets, staged


def rendezvous(key: Column, shards: Sequence[tuple[str, float]]) -> Column:
    """Index of the shard among (name, weight) that the key belongs to."""

    def cost(name: str, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(2**53)
        return -F.log(u) / float(weight)

    draws = [F.struct(cost(n, w).alias("cost"), F.lit(i).alias("shard")) for i, (n, w) in enumerate(shards) if w > 0]
    return F.array_min(F.array(*draws))["shard"]


def shard_records(df: DataFrame, key: Column, columns: dict[str, Column], shards: Sequence[tuple[str, float]], grown: Sequence[tuple[str, float]] | None = None) -> DataFrame:
    """columns of every record with its shard and its slot there, gapless from 0.

    Slots need a rank over all records of a shard. Records are staged with the number of the
    partition that wrote them; each partition ranks its own, and sums over earlier partitions
    give where its run of slots begins. No task sees a whole shard.
    """
    placed = df.select(
        *[c.alias(n) for n, c in columns.items()],
        rendezvous(key, shards).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.spark_partition_id().alias("_block"),
    )
    placed = staged(placed, "shards")
    first = block_offsets(placed, "_block", ["shard"], F.lit(1), "_first")
    own = Window.partitionBy("_block", "shard").orderBy(*columns)
    ranked = placed.withColumn("_rank", F.row_number().over(own) - 1)
    return ranked.join(first, ["_block", "shard"]).select(*columns, "shard", (F.col("_first") + F.col("_rank")).alias("slot"), "grown_shard")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 7 under the law `key`; grown_shard is with a ninth shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    columns = {"doc_id": F.col("doc_id"), "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))}
    names = [(f"shard-{i}", 1.0) for i in range(9)]
    out = shard_records(docs, F.col("doc_id"), columns, names[:8], names)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
