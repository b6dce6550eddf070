"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what the stage before kept, written as Parquet and read again; all but the last
return the columns of documents, and further columns of any name if docs has them.

Defined results: a null or empty text is rejected by the quality rules; where it reaches later
stages, null and blank texts are copies of each other, have no passages and pack as their end token.
Repeated rows are judged alike and one of them passes near-dedup; ties go to the least doc_id, null
last, then the least text hash; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import staged
from foliant.llm.near_copies import keep_first
from foliant.llm.packing import pack, word_tokenizer
from foliant.llm.pu_quality import keep_good
from foliant.llm.quality_rules import keep_passing
from foliant.llm.suffix_dedup import remove_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores 0.5 or more."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return keep_passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shares 4/5 or more of its five-word shingles (SimHash, verified)."""
    return keep_first(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that occur earlier."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids."""
    return pack(docs, word_tokenizer())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs


#: A trained classifier, fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL = None
