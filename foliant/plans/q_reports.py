"""Queries of reports (A*), windows (W*) and the audit (Q*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import audit as Q
from foliant.operators import dedup, reports as O
from .base import ARCHIVE, archive, table
from .q_dedup import FILES, files
from .registry import query

WITH = f"WITH {ARCHIVE} "


@query("a1_stats_by_type", WITH + "SELECT document_type, count(*) AS n, round(avg(ai_confidence), 2) AS confidence FROM archive GROUP BY ALL")
def _(s, d):
    return O.stats_by_type(archive(s, d))


@query("a2_overall_confidence", WITH + "SELECT round(avg(coalesce(ai_confidence, 0)), 6) AS ai, round(avg(coalesce(ocr_confidence, 0)), 6) AS ocr FROM archive")
def _(s, d):
    return O.overall_confidence(archive(s, d)).select(F.round("ai", 6).alias("ai"), F.round("ocr", 6).alias("ocr"))


@query("a3_stats_by_json_attr", WITH + "SELECT json_extract_string(metadata, '$.category') AS value, count(*) AS n FROM archive GROUP BY ALL")
def _(s, d):
    return O.stats_by_json_attr(archive(s, d), "$.category")


@query("a4_hourly_timeline", "SELECT date_trunc('hour', ts) AS slot, count(*) AS n FROM events GROUP BY ALL ORDER BY slot DESC LIMIT 24")
def _(s, d):
    return O.timeline(table(s, d, "events"), "ts")


@query("a5_group_by_sender", WITH + "SELECT coalesce(sender, 'Unknown') AS sender, count(*) AS n, count(*) FILTER (doc_id % 4 = 0) AS unclassified, coalesce(string_agg(DISTINCT CASE WHEN doc_id % 4 <> 0 THEN document_type END, ',' ORDER BY CASE WHEN doc_id % 4 <> 0 THEN document_type END), '') AS types FROM archive GROUP BY ALL")
def _(s, d):
    return O.group_by_sender(archive(s, d).withColumn("document_type", F.when(F.col("doc_id") % 4 != 0, F.col("document_type"))))


@query("a6_database_stats", WITH + "SELECT count(*) AS documents, count(*) FILTER (synced) AS synced, count(DISTINCT document_type) AS types, (SELECT count(*) FROM labels) AS training FROM archive")
def _(s, d):
    return O.database_stats(archive(s, d), table(s, d, "labels"))


@query("a6_documents_by_type", WITH + "SELECT document_type, count(*) AS n, count(*) FILTER (synced) AS synced FROM archive GROUP BY ALL")
def _(s, d):
    return O.documents_by_type(archive(s, d))


@query("a7_confidence_histogram", WITH + "SELECT CASE WHEN ai_confidence <= 0.2 THEN '0-20' WHEN ai_confidence <= 0.4 THEN '21-40' WHEN ai_confidence <= 0.6 THEN '41-60' WHEN ai_confidence <= 0.8 THEN '61-80' ELSE '81-100' END AS bin, count(*) AS n FROM archive WHERE ai_confidence IS NOT NULL GROUP BY ALL")
def _(s, d):
    return O.histogram(archive(s, d), F.col("ai_confidence"), [0.2, 0.4, 0.6, 0.8], ["0-20", "21-40", "41-60", "61-80", "81-100"])


@query("a7_text_length_histogram", "SELECT CASE WHEN n_chars <= 500 THEN 'short' WHEN n_chars <= 2000 THEN 'medium' WHEN n_chars <= 10000 THEN 'long' ELSE 'very long' END AS bin, count(*) AS n FROM documents GROUP BY ALL")
def _(s, d):
    return O.histogram(table(s, d, "documents"), F.col("n_chars"), [500, 2000, 10000], ["short", "medium", "long", "very long"])


@query("a7_language_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("a8_failure_taxonomy", WITH + "SELECT failure, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN ocr_confidence < 0.2 THEN 'ocr' END, CASE WHEN ai_confidence IS NULL THEN 'classification' END, CASE WHEN doc_id % 6 = 0 THEN 'no_extraction' END], lambda x: x IS NOT NULL)) AS failure FROM archive) GROUP BY failure")
def _(s, d):
    return O.failure_taxonomy(archive(s, d), {"ocr": F.col("ocr_confidence") < 0.2, "classification": F.col("ai_confidence").isNull(), "no_extraction": F.col("doc_id") % 6 == 0})


@query("a9_time_stats", "SELECT round(avg(value), 4) AS mean, round(median(value), 4) AS median, min(value) AS least, max(value) AS most, count(*) FILTER (value > 20) AS slow FROM events")
def _(s, d):
    return O.time_stats(table(s, d, "events"), "value", 20).withColumns({"mean": F.round("mean", 4), "median": F.round("median", 4)})


@query("a9_slow_items", "SELECT event_id, value FROM events WHERE value > 20 ORDER BY value DESC")
def _(s, d):
    return O.slow_items(table(s, d, "events"), "value", 20).select("event_id", "value")


@query("a10_funnel_by_type", WITH + ", r AS (SELECT document_type, doc_id % 2 = 0 AS extracted, doc_id % 4 = 0 AS validated, doc_id % 8 = 0 AS perfect FROM archive) SELECT document_type, grouping(document_type) = 1 AS is_total, count(*) AS classified, count(*) FILTER (extracted) AS extracted, count(*) FILTER (validated) AS validated, count(*) FILTER (perfect) AS perfect, round(count(*) FILTER (extracted) / count(*), 4) AS extracted_rate, round(count(*) FILTER (validated) / count(*) FILTER (extracted), 4) AS validated_rate, round(count(*) FILTER (perfect) / count(*) FILTER (validated), 4) AS perfect_rate FROM r GROUP BY ROLLUP (document_type)")
def _(s, d):
    return O.funnel(archive(s, d).selectExpr("document_type", "doc_id % 2 = 0 AS extracted", "doc_id % 4 = 0 AS validated", "doc_id % 8 = 0 AS perfect"), ["extracted", "validated", "perfect"])


@query("a11_quick_wins", "SELECT CASE event_type WHEN 'error' THEN 'look at errors' ELSE 'celebrate' END AS advice, event_type AS metric, count(*)::DOUBLE AS value, CASE event_type WHEN 'error' THEN 1 ELSE 2 END AS priority FROM events WHERE event_type IN ('error', 'purchase') GROUP BY ALL HAVING count(*) > 15")
def _(s, d):
    m = table(s, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return O.quick_wins(m, [("error", "look at errors", 15.0, 1), ("purchase", "celebrate", 15.0, 2), ("click", "never", 1e12, 3)])


@query("a12_consensus_stats", "SELECT event_type AS kind, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS agreed, round(count(*) FILTER (event_id % 3 = 0) / count(*), 4) AS rate, round(avg(value), 4) AS ms FROM events GROUP BY ALL")
def _(s, d):
    return O.consensus_stats(table(s, d, "events").selectExpr("event_type AS kind", "event_id % 3 = 0 AS consensus", "value AS ms"), "kind")


@query("a13_by_extension", FILES + "SELECT 'pdf' AS ext, count(*) AS n FROM files")
def _(s, d):
    return O.by_extension(files(s, d), F.col("path"))


@query("a13_top_folders", "SELECT source AS folder, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, folder LIMIT 20")
def _(s, d):
    return O.top_folders(table(s, d, "documents"), F.col("source"))


@query("a14_cascade_stats", "SELECT count(*) FILTER (l_linenumber = 1) AS took_1, count(*) FILTER (l_linenumber = 2) AS took_2, count(*) FILTER (l_linenumber = 3) AS took_3, count(*) FILTER (l_linenumber = 4) AS took_4, round(avg(l_linenumber), 6) AS mean, round(count(*) FILTER (l_linenumber = 1) / count(*), 6) AS first_try, round(4 * count(*) / sum(l_linenumber), 6) AS speed_up FROM lineitem")
def _(s, d):
    return O.cascade_stats(table(s, d, "lineitem").selectExpr("l_linenumber AS attempts_used")).withColumns({c: F.round(c, 6) for c in ("mean", "first_try", "speed_up")})


def runs(s, d):
    e = table(s, d, "events").withColumn("day", F.date_trunc("day", "ts")).groupBy("user_id", "day")
    r = e.agg(F.count("*").alias("processed"), F.count_if(F.col("event_type") == "error").alias("failed"), F.min("ts").alias("start_time"), F.max("ts").alias("last"), F.count_if(F.col("event_type") == "click").alias("click"), F.count_if(F.col("event_type") == "view").alias("view"))
    return r.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("day", "yyyy-MM-dd")).alias("run_id"), (F.col("user_id") % 10).alias("instance"), "processed", "failed", "start_time", F.when(F.col("processed") % 5 != 0, F.col("last")).alias("end_time"), F.create_map(F.lit("click"), F.col("click"), F.lit("view"), F.col("view")).alias("by_type"))


RUNS = "WITH runs AS (SELECT user_id || '/' || strftime(date_trunc('day', ts), '%Y-%m-%d') AS run_id, user_id % 10 AS instance, count(*) AS processed, count(*) FILTER (event_type = 'error') AS failed, min(ts) AS start_time, CASE WHEN count(*) % 5 <> 0 THEN max(ts) END AS end_time, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id, date_trunc('day', ts)) "


@query("a15_run_rollup", RUNS + "SELECT instance, sum(processed)::BIGINT AS processed, sum(failed)::BIGINT AS failed, min(start_time) AS started, bool_or(end_time IS NULL) AS running, sum(click)::BIGINT AS clicks, sum(view)::BIGINT AS views FROM runs GROUP BY instance")
def _(s, d):
    return O.run_rollup(runs(s, d)).select("instance", "processed", "failed", "started", "running", F.col("by_type")["click"].alias("clicks"), F.col("by_type")["view"].alias("views"))


@query("a16_progress_rates", RUNS + "SELECT run_id, round(100 * processed / greatest(1, processed + 3), 2) AS percent_done, round(100 * (processed - failed) / greatest(1, processed), 2) AS percent_ok FROM runs")
def _(s, d):
    return runs(s, d).select("run_id", *O.progress_rates(F.col("processed") + 3, F.col("processed"), F.col("failed")))


@query("a17_error_summary", "SELECT event_type AS stage, CASE WHEN value > 10 THEN 'slow' ELSE 'fast' END AS error_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return O.error_summary(table(s, d, "events").selectExpr("event_type AS stage", "if(value > 10, 'slow', 'fast') AS error_type"))


@query("a18_recent_runs", RUNS + "SELECT run_id, start_time FROM runs ORDER BY start_time DESC, run_id LIMIT 15")
def _(s, d):
    return O.recent_runs(runs(s, d), 15).select("run_id", "start_time")


@query("a19_session_stats", RUNS + "SELECT count(*) FILTER (event_type <> 'error') AS completed, count(*) FILTER (event_type = 'error') AS failed, round(count(*) FILTER (event_type <> 'error') / count(*), 4) AS success_rate, (SELECT count(*) FROM runs) AS sessions, (SELECT count(*) FROM runs WHERE end_time IS NULL) AS crashed FROM events")
def _(s, d):
    return O.session_stats(table(s, d, "events").selectExpr("if(event_type = 'error', 'failed', 'completed') AS status"), runs(s, d))


EXTRACT = "WITH loc AS (SELECT l_orderkey AS doc_id, count(*) AS item_count, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ALL), mod AS (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS model, item_count + (doc_id % 3 = 0)::INT AS item_count, CASE WHEN doc_id % 5 = 0 THEN total + 1 ELSE total END AS total FROM loc) "


@query("a20_compare_extractions", EXTRACT + "SELECT model, count(*) AS n, round(avg((doc_id % 3 <> 0)::INT), 4) AS count_accuracy, round(avg((doc_id % 5 <> 0)::INT), 4) AS total_accuracy FROM mod GROUP BY model")
def _(s, d):
    loc = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("item_count"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    mod = loc.selectExpr("doc_id", "if(doc_id % 2 = 0, 'a', 'b') AS model", "item_count + if(doc_id % 3 = 0, 1, 0) AS item_count", "if(doc_id % 5 = 0, total + 1, total) AS total")
    return O.compare_extractions(loc, mod)


@query("a19_last_sessions", RUNS + "SELECT run_id, start_time, end_time, processed, failed, CASE WHEN end_time IS NULL THEN 'running' ELSE 'completed' END AS status FROM runs ORDER BY start_time DESC, run_id LIMIT 10")
def _(s, d):
    return O.last_sessions(runs(s, d))


@query("a20_compare_codes", WITH + "SELECT document_type AS model, count(*) AS n, round(avg((doc_id % 3 <> 0)::INT), 4) AS count_accuracy, round(avg((doc_id % 5 <> 0)::INT), 4) AS total_accuracy, round(avg((doc_id % 7 <> 0 AND (doc_id % 4 <> 0 OR sender IS NULL))::INT), 4) AS code_accuracy FROM archive GROUP BY document_type")
def _(s, d):
    loc = archive(s, d).selectExpr("doc_id", "document_type AS model", "1 AS item_count", "amount AS total", "sender AS fik", "file_hash AS bkp")
    mod = loc.selectExpr("doc_id", "model", "item_count + if(doc_id % 3 = 0, 1, 0) AS item_count", "if(doc_id % 5 = 0, total + 1, total) AS total", "if(doc_id % 4 <> 0, fik, NULL) AS fik", "if(doc_id % 7 = 0, 'x', bkp) AS bkp")
    return O.compare_extractions(loc.drop("model"), mod, ["fik", "bkp"])


@query("a21_classifier_accuracy", WITH + "SELECT document_type AS expected, CASE WHEN doc_id % 4 = 0 THEN 'order' ELSE document_type END AS predicted, count(*) AS n, round(avg(ai_confidence), 4) AS confidence FROM archive GROUP BY ALL")
def _(s, d):
    a = archive(s, d)
    return O.classifier_accuracy(a.selectExpr("doc_id", "if(doc_id % 4 = 0, 'order', document_type) AS predicted", "ai_confidence AS confidence"), a.selectExpr("doc_id", "document_type AS expected"))


@query("a21_accuracy_by_label", WITH + ", p AS (SELECT document_type AS expected, ai_confidence AS confidence, (doc_id % 4 <> 0 OR document_type = 'order')::INT AS ok FROM archive) SELECT expected, count(*) AS n, sum(1 - ok)::BIGINT AS incorrect, round(avg(ok), 4) AS accuracy, round(avg(confidence), 4) AS confidence, grouping(expected) = 1 AS is_total FROM p GROUP BY ROLLUP (expected)")
def _(s, d):
    a = archive(s, d)
    return O.accuracy_by_label(a.selectExpr("doc_id", "if(doc_id % 4 = 0, 'order', document_type) AS predicted", "ai_confidence AS confidence"), a.selectExpr("doc_id", "document_type AS expected"))


@query("a22_classifier_throughput", "SELECT event_type AS method, count(*) AS processed, count(*) FILTER (value > 40) AS errors, round(sum(value), 2) AS elapsed, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, round(count(*) / sum(value), 4) AS rate FROM events GROUP BY ALL")
def _(s, d):
    r = table(s, d, "events").selectExpr("event_type AS method", "1 AS processed", "if(value > 40, 1, 0) AS errors", "value AS elapsed")
    return O.classifier_throughput(r).withColumn("elapsed", F.round("elapsed", 2))


@query("a23_override_stats", WITH + "SELECT document_type AS first, count(*) AS n, count(*) FILTER (doc_id % 3 = 0 AND doc_id % 7 <> 0 AND document_type <> 'order') AS changed, count(*) FILTER (doc_id % 7 = 0) AS skipped FROM archive GROUP BY ALL")
def _(s, d):
    return O.override_stats(archive(s, d).selectExpr("document_type AS first", "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'order' ELSE document_type END AS second"))


@query("a24_learned_patterns", WITH + "SELECT document_type, count(*) AS n, round(avg(ocr_confidence), 4) AS strength, min(created_at) AS first_seen, max(created_at) AS last_seen FROM archive GROUP BY ALL")
def _(s, d):
    return O.learned_patterns(archive(s, d).selectExpr("document_type", "ocr_confidence AS strength", "created_at AS seen_at"))


@query("a25_corpus_index", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'tag', t, count(*) FROM (SELECT unnest(['all', 'mod' || doc_id % 3]) AS t FROM documents) GROUP BY t")
def _(s, d):
    docs = table(s, d, "documents").withColumn("tags", F.array(F.lit("all"), F.concat(F.lit("mod"), (F.col("doc_id") % 3).cast("string"))))
    return O.corpus_index(docs, ["lang", "source"], "tags")


@query("a26_queue_stats", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return O.queue_stats(table(s, d, "events").selectExpr("event_type AS status"))


@query("a26_active_workers", "SELECT user_id AS worker, max(ts) AS last_beat FROM events GROUP BY ALL HAVING max(ts) >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3600 SECOND")
def _(s, d):
    return O.active_workers(table(s, d, "events").selectExpr("user_id AS worker", "ts"), "2024-01-31 00:00:00", 3600)


@query("a27_folder_stats", FILES + ", m AS (SELECT location, hash IS NOT NULL AND row_number() OVER (PARTITION BY hash ORDER BY priority, path) > 1 AS dup FROM files) SELECT location, count(*) AS total, count(*) FILTER (NOT dup) AS copied, count(*) FILTER (dup) AS duplicates, round(100 * count(*) FILTER (dup) / count(*), 2) AS duplicate_percent FROM m GROUP BY location")
def _(s, d):
    return O.folder_stats(dedup.mark_duplicates(files(s, d)))


@query("a28_merged_types", WITH + "SELECT document_type, count(*) FILTER (synced) AS ok, count(*) FILTER (NOT synced) AS failed FROM archive GROUP BY ALL")
def _(s, d):
    return O.merged_types(archive(s, d).withColumnRenamed("synced", "success"))


@query("a29_field_completeness", WITH + "SELECT unnest(['ai_confidence', 'ocr_confidence', 'sender']) AS field, unnest([count(ai_confidence), count(ocr_confidence), count(sender)]) AS filled, round(unnest([count(ai_confidence), count(ocr_confidence), count(sender)]) / count(*), 4) AS rate FROM archive")
def _(s, d):
    return O.field_completeness(archive(s, d), ["ai_confidence", "ocr_confidence", "sender"])


@query("a29_completeness_buckets", WITH + ", f AS (SELECT (ai_confidence IS NOT NULL)::INT + (ocr_confidence IS NOT NULL)::INT + (sender IS NOT NULL)::INT AS k FROM archive) SELECT CASE k WHEN 0 THEN 'none' WHEN 1 THEN 'under half' WHEN 2 THEN 'half or more' ELSE 'all' END AS bucket, count(*) AS n FROM f GROUP BY ALL")
def _(s, d):
    return O.completeness_buckets(archive(s, d), ["ai_confidence", "ocr_confidence", "sender"])


@query("a29_least_complete", WITH + "SELECT doc_id, (ai_confidence IS NOT NULL)::INT + (ocr_confidence IS NOT NULL)::INT + (sender IS NOT NULL)::INT AS filled, concat_ws(',', CASE WHEN ai_confidence IS NULL THEN 'ai_confidence' END, CASE WHEN ocr_confidence IS NULL THEN 'ocr_confidence' END, CASE WHEN sender IS NULL THEN 'sender' END) AS missing FROM archive ORDER BY filled, doc_id LIMIT 20")
def _(s, d):
    return O.least_complete(archive(s, d), ["ai_confidence", "ocr_confidence", "sender"])


@query("a30_normalized_type_counts", WITH + "SELECT CASE WHEN document_type IN ('invoice', 'receipt') THEN 'accounting' WHEN document_type = 'order' THEN 'purchase' ELSE 'other' END AS type, count(*) AS n FROM archive GROUP BY ALL")
def _(s, d):
    return O.normalized_type_counts(archive(s, d), {"invoice": "accounting", "receipt": "accounting", "order": "purchase"})


@query("a31_compare_runs", "WITH t AS (SELECT sum(value) FILTER (event_id % 2 = 0) AS base, sum(value) FILTER (event_id % 2 = 1) AS variant FROM events) SELECT round(base, 2) AS base, round(variant, 2) AS variant, round(base / variant, 4) AS speed_up, round(100 * (base - variant) / base, 4) AS saved_percent FROM t")
def _(s, d):
    e = table(s, d, "events")
    return O.compare_runs(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "value").withColumns({c: F.round(c, 2) for c in ("base", "variant")})


@query("w3_sender_share", WITH + "SELECT sender, document_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY sender), 6) AS share FROM archive WHERE sender IS NOT NULL GROUP BY sender, document_type")
def _(s, d):
    from foliant.operators.classify import sender_shares

    return sender_shares(archive(s, d).where("sender is not null").groupBy("sender", "document_type").agg(F.count("*").alias("n"))).withColumn("share", F.round("share", 6))


@query("w8_retry_counts", "SELECT event_id, (sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS retry_count FROM events")
def _(s, d):
    return O.retry_counts(table(s, d, "events").withColumn("failed", F.col("event_type") == "error"), "user_id", ["ts", "event_id"]).select("event_id", "retry_count")


@query("w9_balanced_ranges", "WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, greatest(sum(n) OVER () // 4, 1) AS size FROM c) SELECT least(before // size, 3)::INT AS worker, min(k) AS first, max(k) AS last, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def _(s, d):
    return O.balanced_ranges(table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey", 4)


RULES = [
    Q.Rule("sender_not_empty", "not_empty", "archive", ("sender",)),
    Q.Rule("hash_unique", "unique", "archive", ("file_hash",), "warning"),
    Q.Rule("order_line_unique", "unique", "lineitem", ("l_orderkey", "l_linenumber"), "warning"),
    Q.Rule("customer_exists", "foreign_key", "orders", ("o_custkey",), "error", ("customer", "c_custkey")),
    Q.Rule("part_exists", "foreign_key", "lineitem", ("l_partkey",), "error", ("part", "p_partkey")),
    Q.Rule("quantity_range", "range", "lineitem", ("l_quantity",), "error", (1, 40)),
    Q.Rule("status_domain", "one_of", "orders", ("o_orderstatus",), "error", ("O", "F")),
    Q.Rule("brand_format", "format", "part", ("p_brand",), "warning", ("^Brand#[0-9]$",)),
    Q.Rule("customer_without_order", "orphan", "customer", ("c_custkey",), "warning", ("orders", "o_custkey")),
    Q.Rule("orders_count", "count", "orders"),
    Q.Rule("parts_count", "count", "part"),
]
AUDIT = WITH + """, audit AS (SELECT 'archive' AS "table", 'sender_not_empty' AS name, 'not_empty' AS kind, 'error' AS severity, (SELECT count(*) FROM archive WHERE coalesce(sender, '') = '') AS actual
  UNION ALL SELECT 'archive', 'hash_unique', 'unique', 'warning', (SELECT count(*) FROM (SELECT 1 FROM archive GROUP BY file_hash HAVING count(*) > 1))
  UNION ALL SELECT 'lineitem', 'order_line_unique', 'unique', 'warning', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
  UNION ALL SELECT 'orders', 'customer_exists', 'foreign_key', 'error', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
  UNION ALL SELECT 'lineitem', 'part_exists', 'foreign_key', 'error', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
  UNION ALL SELECT 'lineitem', 'quantity_range', 'range', 'error', (SELECT count(*) FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 40)
  UNION ALL SELECT 'orders', 'status_domain', 'one_of', 'error', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F'))
  UNION ALL SELECT 'part', 'brand_format', 'format', 'warning', (SELECT count(*) FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$'))
  UNION ALL SELECT 'customer', 'customer_without_order', 'orphan', 'warning', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
  UNION ALL SELECT 'orders', 'orders_count', 'count', 'error', (SELECT count(*) FROM orders) UNION ALL SELECT 'part', 'parts_count', 'count', 'error', (SELECT count(*) FROM part)) """


def audited(s, d):
    tables = {n: table(s, d, n) for n in ("orders", "lineitem", "customer", "part")} | {"archive": archive(s, d)}
    return Q.validate_all(tables, RULES)


@query("q9_validate_all", AUDIT + 'SELECT "table", name, kind, severity, actual, kind = \'count\' OR actual = 0 AS passed FROM audit')
def _(s, d):
    return audited(s, d)


@query("q9_audit_summary", AUDIT + "SELECT severity, count(*) AS rules, count(*) FILTER (actual = 0) AS passed, count(*) FILTER (actual > 0) AS failed FROM audit WHERE kind <> 'count' GROUP BY severity")
def _(s, d):
    return Q.audit_summary(audited(s, d))


for _k, _kind in enumerate(("not_empty", "unique", "unique_pair", "foreign_key", "one_of", "format", "orphan", "count"), 1):
    _name = {"unique": "hash_unique", "unique_pair": "order_line_unique"}.get(_kind) or next(r.name for r in RULES if r.kind == _kind)

    @query(f"q{_k}_{_kind}", AUDIT + f"SELECT name, actual FROM audit WHERE name = '{_name}'")
    def _(s, d, name=_name):
        rule = next(r for r in RULES if r.name == name)
        tables = {rule.table: archive(s, d) if rule.table == "archive" else table(s, d, rule.table)} | ({rule.args[0]: table(s, d, rule.args[0])} if rule.kind in ("foreign_key", "orphan") else {})
        return Q.validate_all(tables, [rule]).select("name", "actual")
