"""Queries of sinks and learning (K*, C14, C15) and of sources (S*) over data that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.values import last_line
from foliant.operators import extensions as X
from foliant.operators import learn
from foliant.operators import statements as B
from foliant.sources import readers as S
from foliant.sources import writers as K
from foliant.sources.staging import shared_folder, spread
from .base import ARCHIVE, archive, table, texts
from .q_orders import mixed
from .registry import query

WITH = f"WITH {ARCHIVE} "


@query("k1_export_rows", WITH + "SELECT doc_id, o_orderstatus AS category FROM archive")
def _(s, d):
    return K.export_rows(archive(s, d)).select("doc_id", F.col("metadata")["category"].alias("category"))


@query("k4_upsert", WITH + "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'corrected' ELSE document_type END AS document_type FROM archive WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def _(s, d):
    a = archive(s, d)
    base = a.where("doc_id % 2 = 0").selectExpr("doc_id", "document_type", "1 AS version")
    return K.upsert(base, a.where("doc_id % 3 = 0").selectExpr("doc_id", "'corrected' AS document_type", "2 AS version"), ["doc_id"], "version").drop("version")


CORRECTED = WITH + ", c AS (SELECT doc_id, text, document_type, created_at FROM archive JOIN documents USING (doc_id) WHERE confirmed) "


def corrections(s, d):
    return archive(s, d).where("confirmed").join(texts(s, d).select("doc_id", "text"), "doc_id").select("doc_id", "text", F.col("document_type").alias("corrected_type"), F.col("created_at").alias("corrected_at"))


@query("k5_append_training", CORRECTED + "SELECT doc_id, document_type, 1.0::DOUBLE AS confidence, 'user' AS source FROM c")
def _(s, d):
    return K.append_training(corrections(s, d))[0].drop("text")


@query("k5_append_history", CORRECTED + "SELECT doc_id, 'user_correction' AS method, document_type AS predicted_type, 1.0::DOUBLE AS confidence, created_at AS \"at\" FROM c")
def _(s, d):
    return K.append_training(corrections(s, d))[1]


@query("k6_archive_payload", WITH + "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN subject ELSE 'Document ' || doc_id END AS title, sender AS correspondent, CASE document_type WHEN 'invoice' THEN 'Invoice' WHEN 'order' THEN 'Order' ELSE 'Other' END AS type_name, concat_ws(',', CASE document_type WHEN 'invoice' THEN 'Invoice' WHEN 'order' THEN 'Order' END, CASE WHEN ai_confidence < 0.7 THEN 'check' END) AS tags, CAST(amount AS VARCHAR) AS amount_field, sender AS sender_field FROM archive")
def _(s, d):
    r = archive(s, d).withColumns({"subject": F.when(F.col("doc_id") % 2 == 0, F.col("subject")), "summary": F.lit(" "), "confidence": F.col("ai_confidence")})
    return K.archive_payload(r, {"invoice": "Invoice", "order": "Order"}, ["amount", "sender"]).select("doc_id", "title", "correspondent", "type_name", F.array_join("tags", ",").alias("tags"), *[F.try_element_at("custom_fields", F.lit(c)).alias(f"{c}_field") for c in ("amount", "sender")])


@query("c14_text_model")
def _(s, d):
    labeled = spread(texts(s, d).select("doc_id", "text", F.col("lang").alias("label")), "doc_id")
    return learn.predict_text(learn.train_text_model(labeled), labeled).select("doc_id", "label", "confidence")


@query("c15_should_retrain", WITH + "SELECT count(*) FILTER (created_at > (SELECT max(created_at) FROM archive WHERE document_type = 'order' AND created_at < TIMESTAMP '1998-01-01')) AS fresh, count(*) FILTER (created_at > (SELECT max(created_at) FROM archive WHERE document_type = 'order' AND created_at < TIMESTAMP '1998-01-01')) >= 50 AS retrain FROM archive")
def _(s, d):
    a = archive(s, d)
    history = a.where("document_type = 'order' and created_at < timestamp_ntz'1998-01-01'").selectExpr("'training' AS method", "created_at AS at")
    return learn.should_retrain(a, history)


MAIL = "concat('From: Jan <', coalesce(sender, 'none@x.cz'), '>\\r\\nTo: me@x.cz\\r\\nSubject: ', subject, '\\r\\nMIME-Version: 1.0\\r\\nContent-Type: multipart/mixed; boundary=b\\r\\n\\r\\n--b\\r\\nContent-Type: text/plain\\r\\n\\r\\nHello ', doc_id, '\\r\\n--b\\r\\nContent-Type: application/pdf\\r\\nContent-Disposition: attachment; filename=doc', doc_id, '.pdf\\r\\n\\r\\n', repeat('x', 90 + doc_id % 20), '\\r\\n--b--\\r\\n')"


def mails(s, d):
    few = archive(s, d).select("doc_id", "sender", "subject")  # orders are few bytes and one task, their messages much work
    return S.parse_messages(spread(few, "doc_id").selectExpr("cast(doc_id as string) AS path", f"cast({MAIL} as binary) AS content"))


@query("s1_parse_messages", WITH + "SELECT doc_id::VARCHAR AS path, 'Jan <' || coalesce(sender, 'none@x.cz') || '>' AS sender, subject, (doc_id % 20 >= 10)::INT AS n_attachments FROM archive")
def _(s, d):
    return mails(s, d).select("path", "sender", "subject", F.size("attachments").alias("n_attachments"))


@query("s2_explode_attachments", WITH + "SELECT doc_id::VARCHAR AS path, subject, 'doc' || doc_id || '.pdf' AS filename, 90 + doc_id % 20 AS size, md5(repeat('x', (90 + doc_id % 20)::INT)) AS md5 FROM archive WHERE doc_id % 20 >= 10")
def _(s, d):
    return S.explode_attachments(mails(s, d)).select("path", "subject", "filename", "size", "md5")


@query("s8_rules_table", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def _(s, d):
    from foliant.operators.rules import append_rules, rules_table

    rules = append_rules(rules_table(s, [("lang", x, k, x, 1.0) for k, x in enumerate(["en", "fr"])]), rules_table(s, [("lang", x, k, x, 1.0) for k, x in enumerate(["fr", "de", "es"], 1)]).withColumn("ord", F.when(F.col("label") == "fr", 1).otherwise(F.col("ord")).cast("int")))
    return table(s, d, "documents").join(F.broadcast(rules.select("label", "pattern")), F.col("lang") == F.col("pattern")).groupBy("label").agg(F.count("*").alias("n"))


@query("x1_extractors", WITH + "SELECT doc_id, 'invoice' AS extractor, amount AS total, NULL AS reference FROM archive WHERE document_type = 'invoice' UNION ALL SELECT doc_id, 'order', NULL, subject FROM archive WHERE document_type = 'order'")
def _(s, d):
    return X.run_extractors(archive(s, d), {"invoice": lambda x: x.select("doc_id", F.col("amount").alias("total")), "order": lambda x: x.select("doc_id", F.col("subject").alias("reference"))})


@query("x2_classifiers", WITH + "SELECT doc_id, 'a' AS method, 0 AS ordinal, document_type AS label, 0.5::DOUBLE AS confidence FROM archive UNION ALL SELECT doc_id, 'b', 1, 'order', ai_confidence FROM archive")
def _(s, d):
    return X.run_classifiers(archive(s, d), {"a": lambda x: x.select("doc_id", F.col("document_type").alias("label"), F.lit(0.5).alias("confidence")), "b": lambda x: x.select("doc_id", F.lit("order").alias("label"), F.col("ai_confidence").alias("confidence"))})


@query("s3_file_inventory", "SELECT strftime(o_orderdate, '%Y-%m') AS month, 'archive' AS location, sum(length(o_orderkey::VARCHAR) + 1)::BIGINT AS size, md5(string_agg(o_orderkey::VARCHAR || chr(10), '' ORDER BY o_orderkey)) AS hash FROM orders GROUP BY ALL HAVING sum(length(o_orderkey::VARCHAR) + 1) >= 64")
def _(s, d):
    folder = shared_folder(s)
    rows = table(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey")
    rows.repartition("month").sortWithinPartitions("month", "o_orderkey").select("month", F.col("o_orderkey").cast("string").alias("value")).write.partitionBy("month").text(folder)
    return S.file_inventory(s, folder, ["txt"], "archive", 64).select(F.regexp_extract("path", "month=([0-9-]+)/", 1).alias("month"), "location", "size", "hash")


@query("s4_read_results", WITH + "SELECT 'i' || (doc_id // 50)::VARCHAR AS instance, doc_id, document_type, ai_confidence IS NOT NULL AS success, ai_confidence AS confidence, sender FROM archive")
def _(s, d):
    folder = shared_folder(s)
    result = F.struct("doc_id", "document_type", F.col("ai_confidence").isNotNull().alias("success"), F.col("ai_confidence").alias("confidence"), F.create_map(F.lit("sender"), "sender").alias("fields"))
    archive(s, d).groupBy(F.expr("concat('i', doc_id div 50)").alias("instance")).agg(F.collect_list(result).alias("results")).write.json(folder)  # at most 50 orders each
    return S.read_results(s, folder, whole_files=False).select("instance", "doc_id", "document_type", "success", "confidence", F.col("fields")["sender"].alias("sender"))


@query("s5_read_failures", "SELECT event_id::VARCHAR AS email_id, event_type AS reason, date_trunc('second', ts) AS ts, user_id::VARCHAR AS sender FROM events WHERE event_type = 'error'")
def _(s, d):
    folder = shared_folder(s)
    failed = table(s, d, "events").where("event_type = 'error'")
    failed.select(F.col("event_id").cast("string").alias("email_id"), F.col("event_type").alias("reason"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata")).write.json(folder)
    return S.read_failures(s, folder).select("email_id", "reason", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("metadata")["user"].alias("sender"))


ENCODED = "CASE path::BIGINT % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16' ELSE {} END AS encoding"


@query("s7_read_statements", f"WITH f AS (SELECT DISTINCT l_orderkey::VARCHAR AS path, ['MT940', 'CAMT053', 'ABO', 'CSV', 'FINSTA'][(l_orderkey % 6 + 1)::INT] AS format FROM lineitem WHERE l_orderkey % 6 < 5 UNION ALL SELECT o_orderkey::VARCHAR, 'UNKNOWN' FROM orders WHERE o_orderkey % 6 = 5) SELECT path, format, 'Příkaz č. ' || path || ' – žluťoučký kůň' AS remark, {ENCODED.format(repr('windows-1250'))} FROM f")
def _(s, d):
    remark = F.concat(F.lit("Příkaz č. "), "path", F.lit(" – žluťoučký kůň"))
    whole = F.concat("content", F.lit("\n"), remark)
    single = F.encode(F.translate(whole, S.CP1250, S.LATIN), "ISO-8859-1")
    k = F.col("path").cast("long") % 3
    files = mixed(s, d).select("path", F.when(k == 0, whole.cast("binary")).when(k == 1, F.encode(whole, "UTF-16")).otherwise(single).alias("content"))
    return S.decode_texts(files).select("path", B.detect_format(F.col("content")).alias("format"), last_line(F.col("content")).alias("remark"), "encoding")


@query("s9_catalog_tables", WITH + "SELECT 'documents' AS name, count(*) AS n FROM archive UNION ALL SELECT 'correspondents', count(DISTINCT sender) FROM archive UNION ALL SELECT 'types', count(DISTINCT document_type) FROM archive")
def _(s, d):
    folder, a = shared_folder(s), archive(s, d)
    made = {"documents": a.select("doc_id", "document_type", "sender"), "correspondents": a.select("sender").where("sender is not null").distinct(), "types": a.select("document_type").distinct()}
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}")
    out = None
    for name, df in S.catalog_tables(s, folder, tuple(made)).items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("k2_write_csv", WITH + "SELECT doc_id, subject, sender, amount FROM archive")
def _(s, d):
    folder = shared_folder(s)
    K.write_csv(archive(s, d), folder, ["doc_id", "subject", "sender", "amount"])
    return s.read.schema("doc_id long, subject string, sender string, amount double").csv(folder, header=True)


@query("k3_write_by_type", WITH + "SELECT document_type, doc_id, amount FROM archive WHERE document_type IN ('invoice', 'receipt')")
def _(s, d):
    folder = shared_folder(s)
    K.write_by_type(archive(s, d).select("document_type", "doc_id", "amount"), folder)
    return s.read.parquet(folder).where("document_type in ('invoice', 'receipt')").select("document_type", "doc_id", "amount")  # reads two folders


@query("x5_sequence_similarity", "SELECT p_partkey, round(2.0 * (length(p_name) // 2) / (length(p_name) + length(p_name) // 2), 9)::DOUBLE AS similarity FROM part")
def _(s, d):
    pairs = table(s, d, "part").select("p_partkey", "p_name", F.expr("left(p_name, cast(length(p_name) div 2 as int))").alias("half"))
    return X.sequence_similarity(pairs, "p_name", "half").select("p_partkey", F.round("similarity", 9).alias("similarity"))
