"""Data-quality audit: rules as data, several rules of one table in one scan.

A rule gives one count of violations. Row rules and counts of a table share an aggregate; the
uniqueness, foreign-key and orphan rules each take an aggregation or an anti join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """kind: not_empty, unique, foreign_key, range, one_of, format, orphan or count."""

    name: str
    kind: str
    table: str
    columns: tuple[str, ...] = ()
    severity: str = "error"
    args: tuple = field(default=())


def row_test(rule: Rule):
    c = F.col(rule.columns[0])
    if rule.kind == "not_empty":
        return F.coalesce(c.cast("string"), F.lit("")) == ""
    if rule.kind == "range":
        return ~c.between(*rule.args)
    if rule.kind == "one_of":
        return ~c.isin(list(rule.args))
    if rule.kind == "format":
        return ~c.rlike(rule.args[0])
    return None


def violations(tables: dict[str, DataFrame], rule: Rule) -> DataFrame:
    """One row (name, actual) for a rule that needs its own aggregation or join."""
    df = tables[rule.table]
    keys = list(rule.columns)
    if rule.kind == "unique":
        bad = df.where(F.col(keys[0]).isNotNull()).groupBy(*keys).count().where("count > 1")
    elif rule.kind == "foreign_key":
        parent, key = rule.args
        bad = df.where(F.col(keys[0]).isNotNull()).join(tables[parent].select(F.col(key).alias(keys[0])).distinct(), keys[0], "left_anti")
    elif rule.kind == "orphan":
        child, key = rule.args
        bad = df.join(tables[child].select(F.col(key).alias(keys[0])).distinct(), keys[0], "left_anti")
    else:
        raise ValueError(rule.kind)
    return bad.agg(F.count("*").alias("actual")).select(F.lit(rule.name).alias("name"), "actual")


def validate_all(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """(table, name, kind, severity, actual, passed): counts pass always, others at 0 violations."""
    parts = []
    for table in dict.fromkeys(r.table for r in rules):
        own = [r for r in rules if r.table == table and (r.kind == "count" or row_test(r) is not None)]
        if own:
            one = tables[table].agg(*[(F.count("*") if r.kind == "count" else F.count_if(row_test(r))).alias(r.name) for r in own])
            parts.append(one.unpivot([], [r.name for r in own], "name", "actual"))
    parts += [violations(tables, r) for r in rules if r.kind in ("unique", "foreign_key", "orphan")]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    listed = found.sparkSession.createDataFrame([(r.table, r.name, r.kind, r.severity) for r in rules], "table string, name string, kind string, severity string")
    return listed.join(found, "name").select("table", "name", "kind", "severity", "actual", ((F.col("kind") == "count") | (F.col("actual") == 0)).alias("passed"))


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.where("kind <> 'count'").groupBy("severity").agg(F.count("*").alias("rules"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
