"""Queries of filters, paging and set operations (F*, L*, U*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import filters as O
from .base import ARCHIVE, archive, table, texts
from .registry import query

WITH = f"WITH {ARCHIVE} "


@query("f1_list_documents", WITH + "SELECT doc_id, document_type, created_at FROM archive WHERE document_type = 'invoice' AND contains(sender, '@d3.') ORDER BY created_at DESC, doc_id LIMIT 20 OFFSET 5")
def _(s, d):
    return O.list_documents(archive(s, d), "invoice", "@d3.", 20, 5).select("doc_id", "document_type", "created_at")


@query("f2_select_documents", WITH + "SELECT doc_id, ai_confidence FROM archive WHERE document_type = 'order' AND coalesce(ai_confidence, 0) BETWEEN 0.0 AND 0.5 AND created_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31'")
def _(s, d):
    return O.select_documents(archive(s, d), "order", 0.0, 0.5, "1995-01-01", "1998-12-31").select("doc_id", "ai_confidence")


def attachments(s, d):
    return archive(s, d).select("doc_id", F.col("created_at").alias("date"), "sender", "subject", F.concat(F.lit("scan."), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".xml").otherwise("")).alias("filename"))


ATTACH = f"WITH {ARCHIVE}, att AS (SELECT doc_id, created_at AS date, sender, subject, 'scan.' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.xml' ELSE '' END AS filename FROM archive) "


@query("f3_filter_attachments", ATTACH + "SELECT doc_id, filename FROM att WHERE date < TIMESTAMP '1997-07-01' AND lower(filename) LIKE '%.pdf' AND contains(lower(sender), 'user1') AND contains(lower(subject), 'order 1')")
def _(s, d):
    return O.filter_attachments(attachments(s, d), None, "1997-06-30", "pdf", "USER1", "order 1").select("doc_id", "filename")


@query("f4_in_date_range", WITH + "SELECT doc_id FROM archive WHERE doc_id % 7 = 0 OR created_at >= TIMESTAMP '1997-01-01'")
def _(s, d):
    dated = archive(s, d).withColumn("date", F.when(F.col("doc_id") % 7 == 0, "no date").otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")))
    return O.in_date_range(dated, "date", "1997-01-01", True).select("doc_id")


def lists(s, d):
    a = archive(s, d)
    deny = a.where("o_custkey % 13 = 2").select(F.regexp_extract("sender", "@(.*)$", 1).alias("entry")).where("entry is not null").distinct()
    allow = a.where("o_custkey % 97 = 5 and sender is not null").select(F.upper("sender").alias("entry")).distinct()
    return deny, allow


@query("f5_tag_listed", WITH + "SELECT doc_id, coalesce(o_custkey % 13 = 2 AND sender IS NOT NULL, false) AS denied, sender IS NOT NULL AND o_custkey % 97 = 5 AS allowed FROM archive")
def _(s, d):
    return O.tag_listed(archive(s, d), *lists(s, d)).select("doc_id", "denied", "allowed")


@query("f5_exclude_listed", WITH + "SELECT doc_id FROM archive WHERE sender IS NULL OR o_custkey % 13 <> 2")
def _(s, d):
    return O.exclude_listed(archive(s, d), lists(s, d)[0]).select("doc_id")


@query(
    "f6_update_lists",
    f"""WITH {ARCHIVE}, c AS (SELECT doc_id, lower(sender) AS entry, created_at, CASE WHEN document_type = 'payment' AND ai_confidence > 0.8 THEN 'deny' WHEN document_type IN ('invoice', 'receipt') AND ai_confidence > 0.9 THEN 'allow' END AS list FROM archive WHERE sender IS NOT NULL),
    latest AS (SELECT entry, list FROM c WHERE list IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry ORDER BY created_at DESC, doc_id DESC) = 1),
    old AS (SELECT DISTINCT lower(sender) AS entry, 'allow' AS list FROM archive WHERE o_custkey % 97 = 5 AND sender IS NOT NULL),
    fresh AS (SELECT * FROM latest EXCEPT SELECT * FROM old)
    SELECT entry, list FROM old WHERE entry NOT IN (SELECT entry FROM fresh) UNION ALL SELECT entry, list FROM fresh""",
)
def _(s, d):
    verdicts = archive(s, d).select("doc_id", "sender", F.when(F.col("document_type") == "payment", "advert").otherwise(F.col("document_type")).alias("document_type"), F.col("ai_confidence").alias("confidence"), F.col("created_at").alias("date"))
    deny, allow = lists(s, d)
    return O.update_lists(verdicts, deny.limit(0), allow)


@query("f7_system_notification", WITH + "SELECT doc_id, coalesce(regexp_matches(sender, '^user9'), false) OR regexp_matches(subject, '^Order 4') AS notification FROM archive")
def _(s, d):
    return archive(s, d).select("doc_id", O.is_system_notification(F.col("sender"), F.col("subject"), ["^USER9"], ["^order 4"]).alias("notification"))


@query("f8_marketing", "SELECT doc_id, contains(lower(concat_ws(' ', source, text)), 'worthless') OR contains(lower(concat_ws(' ', source, text)), 'src7') AS marketing FROM documents")
def _(s, d):
    return texts(s, d).select("doc_id", O.is_marketing(F.col("source"), F.col("text"), keywords=["worthless", "src7"]).alias("marketing"))


@query("f9_gibberish", r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) < 0.5 * length(regexp_replace(text, '\s+', '', 'g')) OR length(regexp_replace(text, '\s+', '', 'g')) = 0 AS gibberish FROM documents")
def _(s, d):
    return texts(s, d).select("doc_id", O.is_gibberish(F.col("text")).alias("gibberish"))


@query("f10_good_text", r"SELECT doc_id FROM documents WHERE doc_id * 7 % 101 >= 60 AND length(text) >= 50 AND length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) >= 0.5 * length(regexp_replace(text, '\s+', '', 'g'))")
def _(s, d):
    return texts(s, d).where(O.is_good_text(F.col("doc_id") * 7 % 101, F.col("text"))).select("doc_id")


@query("f11_needs_metadata", WITH + "SELECT doc_id FROM archive JOIN documents USING (doc_id) WHERE document_type IN ('invoice', 'order') AND length(text) > 100 AND doc_id % 4 = 0")
def _(s, d):
    return O.needs_metadata(archive(s, d).join(texts(s, d).select("doc_id", "text"), "doc_id"), ["invoice", "order"]).select("doc_id")


@query("f12_unsynced", WITH + "SELECT doc_id, sender FROM archive WHERE NOT synced")
def _(s, d):
    return O.work_queue(archive(s, d), "synced", False).select("doc_id", "sender")


@query("f12_confirmed", WITH + "SELECT doc_id, document_type FROM archive WHERE confirmed")
def _(s, d):
    return O.work_queue(archive(s, d), "confirmed", True).select("doc_id", "document_type")


@query("f13_min_text", "SELECT doc_id, CASE WHEN length(trim(text, ' ')) < 200 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN length(trim(text, ' ')) < 200 THEN 'text shorter than 200 characters' END AS reason FROM documents")
def _(s, d):
    return O.split_by_length(texts(s, d), 200).select("doc_id", "status", "reason")


@query("f14_supported_ext", ATTACH + "SELECT doc_id FROM att WHERE doc_id % 3 < 2")
def _(s, d):
    return O.supported_ext(attachments(s, d), [".pdf", "XML"]).select("doc_id")


@query("f15_untagged", WITH + "SELECT doc_id FROM archive WHERE doc_id % 6 = 0 AND doc_id % 4 = 0")
def _(s, d):
    tagged = archive(s, d).withColumn("tags", F.when(F.col("doc_id") % 6 != 0, F.array("subject"))).withColumn("document_type", F.when(F.col("doc_id") % 4 != 0, F.col("document_type")))
    return O.untagged(tagged).select("doc_id")


@query("l1_page", WITH + "SELECT doc_id, sender, created_at FROM archive WHERE sender IS NOT NULL ORDER BY created_at DESC, doc_id LIMIT 25 OFFSET 50")
def _(s, d):
    return O.list_documents(archive(s, d).where("sender is not null"), limit=25, offset=50).select("doc_id", "sender", "created_at")


@query("l2_multi_key_order", WITH + "SELECT doc_id, sender, created_at FROM archive ORDER BY sender NULLS FIRST, created_at DESC, doc_id")
def _(s, d):
    return archive(s, d).orderBy("sender", F.desc("created_at"), "doc_id").select("doc_id", "sender", "created_at")


@query("l3_deterministic_sample", WITH + "SELECT doc_id FROM archive ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def _(s, d):
    return O.deterministic_sample(archive(s, d), "doc_id", 50, 7).select("doc_id")


@query("u1_union_phases", WITH + "SELECT doc_id, 'phase1' AS phase, document_type FROM archive WHERE confirmed UNION ALL SELECT doc_id, 'phase2', NULL FROM archive WHERE synced")
def _(s, d):
    a = archive(s, d)
    first = a.where("confirmed").select("doc_id", F.lit("phase1").alias("phase"), "document_type")
    return first.unionByName(a.where("synced").select("doc_id", F.lit("phase2").alias("phase")), allowMissingColumns=True)


@query("u2_union_distinct", "SELECT o_custkey AS id FROM orders UNION SELECT l_partkey FROM lineitem")
def _(s, d):
    return table(s, d, "orders").selectExpr("o_custkey AS id").union(table(s, d, "lineitem").select("l_partkey")).distinct()


@query("u3_unprocessed", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(s, d):
    done = table(s, d, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS o_orderkey")
    return O.unprocessed(table(s, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("u4_retryable", "SELECT CAST(user_id AS VARCHAR) AS file_hash, count(*) AS retry_count, max(ts) AS updated_at FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) < 45")
def _(s, d):
    failed = table(s, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").cast("string").alias("file_hash")).agg(F.count("*").alias("retry_count"), F.max("ts").alias("updated_at"))
    return O.retryable(failed.withColumn("status", F.lit("failed")), 45).select("file_hash", "retry_count", "updated_at")


@query("u5_distinct_types", WITH + "SELECT DISTINCT document_type FROM archive WHERE ai_confidence > 0.5")
def _(s, d):
    return archive(s, d).where("ai_confidence > 0.5").select("document_type").distinct()
