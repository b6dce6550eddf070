"""Rule tables: keyword and pattern configuration as small DataFrames (kind, label, ord, pattern, weight).

``ord`` keeps the order of the configuration, which breaks ties. Rule tables come from configuration
and are bounded by it, so the driver holds them and they may be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kind string, label string, ord int, pattern string, weight double"
#: Most rules folded into one expression.
MOST_FOLDED = 400


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, int, str, float]]) -> DataFrame:
    return spark.createDataFrame(list(rules), SCHEMA)


def append_rules(rules: DataFrame, more: DataFrame) -> DataFrame:
    """Extend a rule table by rows; equal rows count once."""
    return rules.unionByName(more).distinct()


def folded(rules: DataFrame) -> list:
    """The rules in order; configuration, so the driver holds them."""
    return rules.orderBy("ord", "label", "pattern").collect()


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first (label, pattern) whose pattern the text contains."""
    out = F.lit(default)
    for label, pattern in reversed(rules):
        out = F.when(text.contains(pattern), F.lit(label)).otherwise(out)
    return out


def count_contained(text: Column, keywords: Iterable[str]) -> Column:
    """How many of the keywords the text contains."""
    out = F.lit(0)
    for k in keywords:
        out = out + text.contains(k).cast("int")
    return out


def any_like(text: Column, patterns: Iterable[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))
