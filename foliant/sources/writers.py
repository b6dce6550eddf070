"""Sinks: exports, upserts, training rows and archive records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(docs: DataFrame, path: str, metadata_schema: str = "map<string,string>") -> None:
    """All columns as JSON lines, newest first, the metadata text parsed to an object."""
    export_rows(docs, metadata_schema).write.mode("overwrite").json(path)


def export_rows(docs: DataFrame, metadata_schema: str = "map<string,string>") -> DataFrame:
    return docs.withColumn("metadata", F.from_json("metadata", metadata_schema)).orderBy(F.desc("created_at"), "doc_id")


def write_csv(docs: DataFrame, path: str, columns: list[str]) -> None:
    docs.select(*columns).write.mode("overwrite").csv(path, header=True)


def write_by_type(docs: DataFrame, path: str) -> None:
    """Parquet partitioned by document type; AQE splits a type that holds most documents."""
    docs.hint("rebalance", "document_type").write.mode("overwrite").partitionBy("document_type").parquet(path)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The record of the greatest version of each key; an update wins over a base record of the same version."""
    both = base.withColumn("_u", F.lit(0)).unionByName(updates.withColumn("_u", F.lit(1)), allowMissingColumns=True)
    values = [c for c in both.columns if c not in (*keys, "_u")]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(version, "_u")).alias("v"))
    return newest.select(*keys, "v.*")


def append_training(corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training rows and history rows of corrections (doc_id, text, corrected_type, corrected_at), confidence 1."""
    training = corrections.select("doc_id", "text", F.col("corrected_type").alias("document_type"), F.lit(1.0).alias("confidence"), F.lit("user").alias("source"))
    history = corrections.select("doc_id", F.lit("user_correction").alias("method"), F.col("corrected_type").alias("predicted_type"), F.lit(1.0).alias("confidence"), F.col("corrected_at").alias("at"))
    return training, history


def archive_payload(results: DataFrame, type_names: dict[str, str], fields: list[str]) -> DataFrame:
    """Archive record: title of 128 characters at most, correspondent, type name, tags, fields cut at 500."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in type_names.items() for x in kv]), F.col("document_type"))
    title = F.substring(F.coalesce(F.nullif(F.trim("subject"), F.lit("")), F.nullif(F.trim("summary"), F.lit("")), F.concat(F.lit("Document "), F.col("doc_id").cast("string"))), 1, 128)
    tags = F.array_compact(F.array(name, F.when(F.col("confidence") < 0.7, F.lit("check"))))
    cut = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.substring(F.col(f).cast("string"), 1, 500) for f in fields])), lambda k, v: v.isNotNull())
    return results.select("doc_id", title.alias("title"), F.col("sender").alias("correspondent"), F.coalesce(name, F.lit("Other")).alias("type_name"), tags.alias("tags"), cut.alias("custom_fields"))
