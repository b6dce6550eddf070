"""Document matching: orders, invoices, deliveries and payments by shared numbers, chains and links.

All joins are equi joins on keys that are null where a document has none, so that nulls never
meet. The either-of conditions of point lookups become unions of equi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .forest import paths

#: Key, its rank among keys, and the slots that it fills.
KEYS = [("order_number", 1, ["order", "invoice", "delivery_note"]), ("invoice_number", 2, ["invoice", "delivery_note", "payment"]), ("variable_symbol", 3, ["invoice", "payment"])]
#: Types of documents that fill a slot not named after them.
FILLS = {"bank_statement": "payment"}
SLOTS = ["order", "invoice", "delivery_note", "payment"]


def slot_of(document_type: Column) -> Column:
    out = document_type
    for kind, slot in FILLS.items():
        out = F.when(document_type == kind, slot).otherwise(out)
    return out


def match_by(meta: DataFrame, key: str, rank: int, slots: list[str]) -> DataFrame:
    """(doc_id, slot, match_id, key_rank, created_at): for each slot the newest other document with the same key value, then least id.

    A value's documents are first reduced to the two best of each slot, one of which may be the
    document itself; values that many documents share are never paired.
    """
    right = meta.where(F.col(key).isNotNull()).select(F.col(key).alias("value"), slot_of(F.col("document_type")).alias("slot"), F.col("doc_id").alias("match_id"), "created_at").where(F.col("slot").isin(slots))
    place = Window.partitionBy("value", "slot").orderBy(F.desc("created_at"), "match_id")
    best = right.withColumn("_n", F.row_number().over(place)).where("_n <= 2")
    best = best.groupBy("value", "slot").agg(F.array_sort(F.collect_list(F.struct("_n", "match_id", "created_at"))).alias("best"))
    left = meta.where(F.col(key).isNotNull()).select("doc_id", F.col(key).alias("value"))
    first = F.get(F.filter("best", lambda b: b["match_id"] != F.col("doc_id")), F.lit(0))
    return left.join(best, "value").select("doc_id", "slot", first["match_id"].alias("match_id"), F.lit(rank).alias("key_rank"), first["created_at"].alias("created_at")).where("match_id is not null")


def pick_matches(meta: DataFrame) -> DataFrame:
    """(doc_id, slot, match_id): one match a slot, by key, then newest, then least id."""
    found = None
    for key, rank, slots in KEYS:
        one = match_by(meta, key, rank, slots)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "slot").agg(F.min_by("match_id", "key_rank").alias("match_id"))


def build_chains(meta: DataFrame) -> DataFrame:
    """One chain for each order with a match, and for each invoice that no order's chain holds.

    Columns: chain_id, the slots' ids, total_amount and vendor from the first slot that has them,
    and status.
    """
    matches = pick_matches(meta)
    slots = matches.groupBy("doc_id").agg(*[F.max(F.when(F.col("slot") == s, F.col("match_id"))).alias(f"m_{s}") for s in SLOTS])
    rooted = slots.join(meta.select("doc_id", "document_type"), "doc_id")
    fill = lambda df, root: df.select(F.concat(F.lit("CHAIN-"), F.col("doc_id").cast("string")).alias("chain_id"), *[(F.col("doc_id") if s == root else F.col(f"m_{s}")).alias(f"{s}_id") for s in SLOTS])
    orders = fill(rooted.where("document_type = 'order'"), "order")
    taken = orders.select(F.col("invoice_id").alias("doc_id")).where("doc_id is not null").distinct()
    invoices = fill(rooted.where("document_type = 'invoice' and m_order is null").join(taken, "doc_id", "left_anti"), "invoice")
    chains = orders.unionByName(invoices)
    for s in SLOTS:
        chains = chains.join(meta.select(F.col("doc_id").alias(f"{s}_id"), F.col("amount").alias(f"a_{s}"), F.col("vendor").alias(f"v_{s}")), f"{s}_id", "left")
    return chains.select("chain_id", *[f"{s}_id" for s in SLOTS], F.coalesce(*[f"a_{s}" for s in SLOTS]).alias("total_amount"), F.coalesce(*[f"v_{s}" for s in SLOTS]).alias("vendor"), chain_status().alias("status"))


def chain_status():
    return F.when(F.col("payment_id").isNotNull(), "completed").when(F.col("delivery_note_id").isNotNull(), "delivered").when(F.col("invoice_id").isNotNull(), "invoiced").when(F.col("order_id").isNotNull(), "ordered").otherwise("unknown")


def backfill_chain_amounts(chains: DataFrame, docs: DataFrame) -> DataFrame:
    """Chains whose null totals are filled from the invoice's JSON metadata; filled tells which."""
    known = docs.select(F.col("doc_id").alias("invoice_id"), F.get_json_object("metadata", "$.amount").cast("double").alias("json_amount"))
    out = chains.join(known, "invoice_id", "left")
    fill = F.col("total_amount").isNull() & F.col("json_amount").isNotNull()
    return out.withColumn("filled", fill).withColumn("total_amount", F.coalesce("total_amount", "json_amount")).drop("json_amount")


def members(chains: DataFrame) -> DataFrame:
    """(chain_id, slot, doc_id) of all filled slots."""
    return chains.unpivot(["chain_id"], [f"{s}_id" for s in SLOTS], "slot", "doc_id").where("doc_id is not null")


def unmatched_documents(docs: DataFrame, chains: DataFrame, n: int = 500) -> DataFrame:
    return docs.join(members(chains).select("doc_id").distinct(), "doc_id", "left_anti").orderBy(F.desc("created_at"), "doc_id").limit(n)


def chain_coverage(docs: DataFrame, chains: DataFrame) -> DataFrame:
    """One row: chains, documents in chains, documents, and those in none."""
    per = chains.agg(F.count("*").alias("chains"), F.count_if(F.col("status") == "completed").alias("completed"))
    inside = members(chains).agg(F.countDistinct("doc_id").alias("in_chains"))
    total = docs.agg(F.count("*").alias("documents"))
    one = per.crossJoin(inside).crossJoin(total)  # one row each
    return one.withColumn("unmatched", F.col("documents") - F.col("in_chains"))


def document_detail(docs: DataFrame, meta: DataFrame) -> DataFrame:
    return docs.join(meta, "doc_id", "left")


def chains_by_status(chains: DataFrame, k: int = 10) -> DataFrame:
    """The first k chains of each status by total amount."""
    own = Window.partitionBy("status").orderBy(F.desc("total_amount"), "chain_id")
    return chains.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def attach_results(archive: DataFrame, results: DataFrame) -> DataFrame:
    """archive (doc_id, title) with the results whose id their titles carry after '#'; others stay unmatched."""
    keyed = archive.withColumn("result_id", F.nullif(F.regexp_extract("title", r"#(\d+)", 1), F.lit("")).cast("long"))
    return keyed.join(results, "result_id", "left")


def attach_mail_source(files: DataFrame, attachments: DataFrame) -> DataFrame:
    return files.join(attachments.select("saved_path", "sender", "subject"), files["path"] == attachments["saved_path"], "left").drop("saved_path")


def reuse_cached(files: DataFrame, documents: DataFrame) -> DataFrame:
    """files with the type and confidence of the earliest document of the same hash, and hit."""
    first = documents.groupBy("file_hash").agg(F.min_by(F.struct("document_type", "ai_confidence"), "doc_id").alias("c"))
    out = files.join(first, "file_hash", "left")
    return out.select(*files.columns, F.col("c.document_type").alias("cached_type"), F.col("c.ai_confidence").alias("cached_confidence"), F.col("c").isNotNull().alias("hit"))


def cache_stats(reused: DataFrame) -> DataFrame:
    return reused.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.try_divide(F.count_if("hit"), F.count("*")), 4).alias("hit_rate"))


def resolve_entities(payloads: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """payloads with the catalog id of their name, case ignored; id null if it must be created."""
    ids = catalog.groupBy(F.lower("name").alias("_low")).agg(F.min("id").alias("entity_id"))
    return payloads.join(ids, F.lower(payloads[name]) == ids["_low"], "left").drop("_low")


def to_create(resolved: DataFrame, name: str) -> DataFrame:
    return resolved.where("entity_id is null").select(F.lower(name).alias("name")).where("name is not null").distinct()


def type_paths(nodes: DataFrame) -> DataFrame:
    """(id, path) of nodes (id, parent_id, name): names from the root down, joined by ' > '.

    Of any depth and number. Nodes on or below a cycle, or below a parent that isn't there, have no path
    and are left out. The rounds run when this is called.
    """
    return paths(nodes)
