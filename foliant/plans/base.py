"""Tables that the queries share, derived by Spark from the given ones, and the same in SQL.

``archive``  one document for each order: type, confidences, sender, subject, JSON metadata, hash
``texts``    the corpus texts with lower-cased text
``runs``     extraction runs made of events: one item an event, a run a user and day
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"1-URGENT": "invoice", "2-HIGH": "order", "3-MEDIUM": "delivery_note", "4-NOT SPECIFIED": "payment", "5-LOW": "receipt"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_of(table(spark, sf_dir, "orders"))


def archive_of(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS doc_id",
        "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " END AS document_type",
        "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey * 37 % 101 AS DOUBLE) / 100 END AS ai_confidence",
        "CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey * 53 % 101 AS DOUBLE) / 100 END AS ocr_confidence",
        "CASE WHEN o_orderkey % 17 <> 0 THEN concat('user', o_custkey % 97, '@d', o_custkey % 13, '.example.com') END AS sender",
        "concat('Order ', o_orderkey % 50) AS subject",
        "o_orderdate AS created_at",
        "o_totalprice AS amount",
        "md5(cast(o_orderkey % 4001 AS string)) AS file_hash",
        "concat('{\"amount\":', CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE cast(o_orderkey AS string) END, ',\"category\":\"', o_orderstatus, '\"}') AS metadata",
        "o_orderkey % 3 = 0 AS synced",
        "o_orderkey % 5 = 0 AS confirmed",
        "o_custkey",
        "o_orderstatus",
    )


ARCHIVE = (
    "archive AS (SELECT o_orderkey AS doc_id, CASE o_orderpriority "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items())
    + """ END AS document_type,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey * 37 % 101 AS DOUBLE) / 100 END AS ai_confidence,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey * 53 % 101 AS DOUBLE) / 100 END AS ocr_confidence,
  CASE WHEN o_orderkey % 17 <> 0 THEN 'user' || o_custkey % 97 || '@d' || o_custkey % 13 || '.example.com' END AS sender,
  'Order ' || o_orderkey % 50 AS subject, o_orderdate AS created_at, o_totalprice AS amount,
  md5(CAST(o_orderkey % 4001 AS VARCHAR)) AS file_hash,
  '{"amount":' || CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE CAST(o_orderkey AS VARCHAR) END || ',"category":"' || o_orderstatus || '"}' AS metadata,
  o_orderkey % 3 = 0 AS synced, o_orderkey % 5 = 0 AS confirmed, o_custkey, o_orderstatus
  FROM orders)"""
)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.lower("text").alias("lower_text"), "lang", "source")


#: kind, label, ord, keyword: words that occur in the corpus's four languages.
WORD_RULES = [
    (label, k, word)
    for k, (label, words) in enumerate({"en": ["the ", " and ", " that ", " with ", "tion"], "fr": [" que ", " les ", " pour ", "eau", " dans "], "de": [" und ", " der ", " die ", "sch", " nicht "], "es": [" los ", " con ", "ción", " del ", " por "]}.items())
    for word in words
]
RULES_SQL = "rules(label, ord, pattern) AS (VALUES " + ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in WORD_RULES) + ")"


def word_rules(spark: SparkSession) -> DataFrame:
    from foliant.operators.rules import rules_table

    return rules_table(spark, [("keyword", label, k, word, 1.0) for label, k, word in WORD_RULES])
