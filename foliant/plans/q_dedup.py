"""Queries of duplicates and merging (D*) and of document matching (J*, W1, W2, W10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import names as N
from foliant.operators import dedup as O
from foliant.operators import matching as M
from .base import ARCHIVE, archive, table, texts
from .registry import query

WITH = f"WITH {ARCHIVE} "


@query("d1_dedup_exact", WITH + "SELECT doc_id, file_hash FROM archive QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY created_at, doc_id) = 1")
def _(s, d):
    return O.dedup_exact(archive(s, d), "file_hash", ["created_at"], "doc_id").select("doc_id", "file_hash")


@query("d1_dedup_exact_texts", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(s, d):
    return O.dedup_exact(texts(s, d).withColumn("h", F.sha2("text", 256)), "h", [], "doc_id").select("doc_id")


FILES = f"WITH {ARCHIVE}, files AS (SELECT CASE WHEN doc_id % 29 <> 0 THEN file_hash END AS hash, CASE doc_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'cloud' ELSE 'archive' END AS location, doc_id % 3 AS priority, '/' || o_orderstatus || '/' || doc_id || '.pdf' AS path, doc_id % 4001 + 100 AS size FROM archive) "


def files(s, d):
    return archive(s, d).selectExpr("if(doc_id % 29 <> 0, file_hash, null) AS hash", "CASE doc_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'cloud' ELSE 'archive' END AS location", "doc_id % 3 AS priority", "concat('/', o_orderstatus, '/', doc_id, '.pdf') AS path", "doc_id % 4001 + 100 AS size")


@query("d2_mark_duplicates", FILES + "SELECT path, hash IS NOT NULL AND row_number() OVER w > 1 AS is_duplicate, CASE WHEN hash IS NOT NULL AND row_number() OVER w > 1 THEN first_value(path) OVER w END AS duplicate_of FROM files WINDOW w AS (PARTITION BY hash ORDER BY priority, path)")
def _(s, d):
    return O.mark_duplicates(files(s, d)).select("path", "is_duplicate", "duplicate_of")


@query("d3_text_fingerprint", r"SELECT doc_id, CASE WHEN length(text) > 100 THEN md5(substr(regexp_replace(lower(text), '[\x20\x09-\x0D]+', '', 'g'), 1, 2000)) END AS fingerprint FROM documents")
def _(s, d):
    return texts(s, d).select("doc_id", N.text_fingerprint(F.col("text")).alias("fingerprint"))


#: Letters beyond ASCII that occur in the corpus; DuckDB counts edits in bytes, so they become control characters.
ACCENTED = "éóèñçüêäößíÉÈÑÓÇÊÜÄÖÍ"
PLAIN = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 27)])
#: Differences of letter counts bound the edits from below; of the pairs left the edits are counted.
COUNTS = "[" + ", ".join(f"length(head) - length(replace(head, '{c}', ''))" for c in "etaoinshrdlucmfwypvbgk .,") + "]"
SIMILAR = f"""h AS (SELECT head, min(doc_id) AS first_id FROM (SELECT doc_id, substr(translate(text, '{ACCENTED}', {PLAIN}), 1, 1000) AS head FROM rest WHERE length(text) > 0) GROUP BY head),
  c AS (SELECT *, {COUNTS} AS counts FROM h),
  p AS (SELECT a.head AS x, b.head AS y, a.first_id AS u, b.first_id AS v, greatest(length(a.head), length(b.head)) AS n FROM c a JOIN c b ON a.first_id < b.first_id AND abs(length(a.head) - length(b.head)) <= 50
    WHERE greatest(list_sum(list_transform(list_zip(a.counts, b.counts), lambda z: greatest(z[1] - z[2], 0))), list_sum(list_transform(list_zip(a.counts, b.counts), lambda z: greatest(z[2] - z[1], 0)))) <= n * 0.05 + 1e-9),
  e AS MATERIALIZED (SELECT u, v, n, levenshtein(x, y) AS edits FROM p), close AS (SELECT u, v, 1 - edits / n AS similarity FROM e WHERE edits <= floor(n * 0.05 + 1e-9)),
  near AS (SELECT u AS first_id, v AS other, similarity FROM close UNION ALL SELECT v, u, similarity FROM close UNION ALL SELECT first_id, first_id, 1.0 FROM h),
  best AS (SELECT first_id, min(other) AS other, arg_min(similarity, other) AS similarity FROM near GROUP BY first_id),
  matches AS (SELECT doc_id, other AS duplicate_of, similarity FROM rest JOIN h ON substr(translate(text, '{ACCENTED}', {PLAIN}), 1, 1000) = h.head JOIN best USING (first_id) WHERE other < doc_id)"""


@query("d4_near_duplicates", f"WITH rest AS (SELECT doc_id, text FROM documents), {SIMILAR} SELECT * FROM matches")
def _(s, d):
    return O.near_duplicates(texts(s, d))


CASCADE = r"""WITH hashed AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS same, CASE WHEN length(text) > 100 THEN md5(substr(regexp_replace(lower(text), '[\x20\x09-\x0D]+', '', 'g'), 1, 2000)) END AS fp FROM documents),
  unlike AS (SELECT *, min(doc_id) OVER (PARTITION BY fp) AS alike FROM hashed WHERE same = doc_id),
  rest AS (SELECT doc_id, text FROM unlike WHERE fp IS NULL OR alike = doc_id), """ + SIMILAR + """,
  found AS (SELECT doc_id, 'file_hash' AS reason, same AS matched FROM hashed WHERE same < doc_id UNION ALL SELECT doc_id, 'text_hash', alike FROM unlike WHERE fp IS NOT NULL AND alike < doc_id UNION ALL SELECT doc_id, 'similarity', duplicate_of FROM matches) """


@query("d5_dedup_cascade", CASCADE + "SELECT * FROM found")
def _(s, d):
    return O.dedup_cascade(texts(s, d).withColumn("file_hash", F.md5("text")))


@query("d5_duplicate_clusters", CASCADE.replace("WITH ", "WITH RECURSIVE ", 1) + """, tree(doc_id, cluster_id) AS (SELECT matched, matched FROM found WHERE matched NOT IN (SELECT doc_id FROM found) UNION SELECT f.doc_id, t.cluster_id FROM found f JOIN tree t ON f.matched = t.doc_id)
  SELECT doc_id, cluster_id, reason, matched FROM tree LEFT JOIN found USING (doc_id)""")
def _(s, d):
    return O.duplicate_clusters(O.dedup_cascade(texts(s, d).withColumn("file_hash", F.md5("text"))))


@query("d6_cross_location", FILES + "SELECT f.hash, p.path AS primary_path, location, f.path FROM files f JOIN (SELECT hash, min(path) AS path FROM files WHERE location = 'local' GROUP BY hash) p USING (hash) WHERE location <> 'local'")
def _(s, d):
    return O.cross_location(files(s, d), "local")


@query("d6_copies_report", FILES + "SELECT hash, count(*) AS copies, count(DISTINCT location) AS locations, max(size) AS bytes FROM files WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) >= 3")
def _(s, d):
    return O.copies_report(files(s, d))


@query("d7_savings", FILES + ", g AS (SELECT hash, count(*) AS n, max(size) AS size FROM files WHERE hash IS NOT NULL GROUP BY hash) SELECT sum(n)::BIGINT AS total, count(*) AS \"unique\", sum(n - 1)::BIGINT AS duplicates, sum((n - 1) * size)::BIGINT AS reclaimable FROM g")
def _(s, d):
    return O.savings(files(s, d))


@query("d8_new_only", FILES + "SELECT path FROM files WHERE location = 'cloud' AND (hash IS NULL OR hash NOT IN (SELECT hash FROM files WHERE location = 'archive' AND hash IS NOT NULL))")
def _(s, d):
    f = files(s, d)
    return O.new_only(f.where("location = 'cloud'"), f.where("location = 'archive'")).select("path")


CORR = """WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Firm ' || chr(65 + (c_custkey // 5 % 26)::INT) || c_nationkey || ' s.r.o.' WHEN 1 THEN 'firm ' || chr(97 + (c_custkey // 5 % 26)::INT) || c_nationkey || ', Ltd' WHEN 2 THEN 'Firm ' || chr(65 + (c_custkey // 5 % 26)::INT) || c_nationkey || ' <a@b.cz>'
  WHEN 3 THEN 'FIRM ' || chr(65 + (c_custkey // 5 % 26)::INT) || c_nationkey || ' Newsletter' ELSE '★ Firm ' || chr(65 + (c_custkey // 5 % 26)::INT) || c_nationkey || '.com' END AS name, c_custkey % 17 AS document_count, 'firm ' || chr(97 + (c_custkey // 5 % 26)::INT) || c_nationkey AS norm FROM customer) """


def correspondents(s, d):
    base = "concat(%s, {c}, c_nationkey, %s)"
    up, low = "chr(65 + (c_custkey div 5) % 26)", "chr(97 + (c_custkey div 5) % 26)"
    forms = [("'Firm '", up, "' s.r.o.'"), ("'firm '", low, "', Ltd'"), ("'Firm '", up, "' <a@b.cz>'"), ("'FIRM '", up, "' Newsletter'"), ("'★ Firm '", up, "'.com'")]
    case = "CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN " + (base % (a, b)).format(c=c) for i, (a, c, b) in enumerate(forms)) + " END"
    return table(s, d, "customer").selectExpr("c_custkey AS id", f"{case} AS name", "c_custkey % 17 AS document_count")


@query("d9_normalize_name", CORR + "SELECT id, norm FROM c")
def _(s, d):
    return correspondents(s, d).select("id", N.normalize_name(F.col("name")).alias("norm"))


@query("d10_display_name", CORR + "SELECT id, CASE WHEN norm = 'firm a1' THEN 'Firm A-One' ELSE trim(replace(replace(name, '★', ''), ' <a@b.cz>', '')) END AS display FROM c")
def _(s, d):
    return correspondents(s, d).select("id", N.display_name(F.col("name"), {"firm a1": "Firm A-One"}).alias("display"))


@query("d11_name_groups", CORR + "SELECT id, norm, count(*) OVER w AS members, (sum(document_count) OVER w)::BIGINT AS documents FROM c WINDOW w AS (PARTITION BY norm) QUALIFY count(*) OVER w > 1 AND sum(document_count) OVER w >= 10")
def _(s, d):
    return O.name_groups(correspondents(s, d), 10).select("id", "norm", "members", "documents")


PENALTY = r"length(regexp_replace(name, '[\p{L}\p{N}_\s.,\-]', '', 'g')), CASE WHEN name = upper(name) OR name = lower(name) THEN 2 ELSE 0 END, length(name), name"


@query("d12_canonical_name", CORR + f", g AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY norm) > 1) SELECT norm, name AS canonical FROM g QUALIFY row_number() OVER (PARTITION BY norm ORDER BY {PENALTY}) = 1")
def _(s, d):
    return O.canonical_names(O.name_groups(correspondents(s, d)))


PLAN = CORR + f", g AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY norm) > 1), l AS (SELECT norm, (SELECT id FROM g x WHERE x.norm = g.norm ORDER BY document_count DESC, id LIMIT 1) AS primary_id, (SELECT name FROM g x WHERE x.norm = g.norm ORDER BY {PENALTY} LIMIT 1) AS target_name FROM g GROUP BY norm), plan AS (SELECT id, primary_id, target_name FROM g JOIN l USING (norm) WHERE id <> primary_id) "


@query("d13_merge_plan", PLAN + "SELECT * FROM plan")
def _(s, d):
    return O.merge_plan(correspondents(s, d))


@query("d14_apply_merge", PLAN + "SELECT o_orderkey AS doc_id, coalesce(primary_id, o_custkey) AS correspondent_id, primary_id IS NOT NULL AS moved FROM orders LEFT JOIN plan ON id = o_custkey")
def _(s, d):
    docs = table(s, d, "orders").selectExpr("o_orderkey AS doc_id", "o_custkey AS correspondent_id")
    return O.apply_merge(docs, O.merge_plan(correspondents(s, d))).select("doc_id", "correspondent_id", "moved")


META = f"""WITH {ARCHIVE}, meta AS (SELECT doc_id, CASE WHEN document_type = 'receipt' AND doc_id % 2 = 0 THEN 'bank_statement' ELSE document_type END AS document_type, created_at, CASE WHEN doc_id % 5 <> 0 THEN 'PO' || doc_id // 4 END AS order_number, CASE WHEN doc_id % 3 <> 0 THEN 'F' || doc_id // 3 END AS invoice_number,
  CASE WHEN doc_id % 7 < 3 THEN CAST(doc_id // 6 AS VARCHAR) END AS variable_symbol, CASE WHEN doc_id % 4 <> 0 THEN amount END AS amount, CASE WHEN doc_id % 3 <> 1 THEN sender END AS vendor FROM archive) """


def meta(s, d):
    return archive(s, d).selectExpr("doc_id", "if(document_type = 'receipt' and doc_id % 2 = 0, 'bank_statement', document_type) AS document_type", "created_at", "if(doc_id % 5 <> 0, concat('PO', doc_id div 4), null) AS order_number", "if(doc_id % 3 <> 0, concat('F', doc_id div 3), null) AS invoice_number", "if(doc_id % 7 < 3, cast(doc_id div 6 AS string), null) AS variable_symbol", "if(doc_id % 4 <> 0, amount, null) AS amount", "if(doc_id % 3 <> 1, sender, null) AS vendor")


CAND = META + """, fill AS (SELECT *, CASE document_type WHEN 'bank_statement' THEN 'payment' ELSE document_type END AS slot FROM meta), cand AS (SELECT a.doc_id, b.slot, b.doc_id AS match_id, 1 AS key_rank, b.created_at FROM meta a JOIN fill b USING (order_number) WHERE a.doc_id <> b.doc_id AND b.slot IN ('order', 'invoice', 'delivery_note')
  UNION ALL SELECT a.doc_id, b.slot, b.doc_id, 2, b.created_at FROM meta a JOIN fill b USING (invoice_number) WHERE a.doc_id <> b.doc_id AND b.slot IN ('invoice', 'delivery_note', 'payment')
  UNION ALL SELECT a.doc_id, b.slot, b.doc_id, 3, b.created_at FROM meta a JOIN fill b USING (variable_symbol) WHERE a.doc_id <> b.doc_id AND b.slot IN ('invoice', 'payment')),
  picked AS (SELECT doc_id, slot, match_id FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id, slot ORDER BY key_rank, created_at DESC, match_id) = 1) """

for _k, (_key, _rank, _types) in enumerate(M.KEYS, 1):

    @query(f"j{_k}_match_by_{_key}", CAND + f"SELECT doc_id, slot, match_id FROM cand WHERE key_rank = {_rank} QUALIFY row_number() OVER (PARTITION BY doc_id, slot ORDER BY created_at DESC, match_id) = 1")
    def _(s, d, key=_key, rank=_rank, types=_types):
        return M.match_by(meta(s, d), key, rank, types).select("doc_id", "slot", "match_id")


@query("j4_pick_matches", CAND + "SELECT * FROM picked")
def _(s, d):
    return M.pick_matches(meta(s, d))


CHAINS = CAND + """, slots AS (SELECT doc_id, max(CASE WHEN slot = 'order' THEN match_id END) AS o, max(CASE WHEN slot = 'invoice' THEN match_id END) AS i, max(CASE WHEN slot = 'delivery_note' THEN match_id END) AS n, max(CASE WHEN slot = 'payment' THEN match_id END) AS p FROM picked GROUP BY doc_id),
  oc AS (SELECT doc_id AS root, doc_id AS order_id, i AS invoice_id, n AS delivery_note_id, p AS payment_id FROM slots JOIN meta USING (doc_id) WHERE document_type = 'order'),
  raw AS (SELECT * FROM oc UNION ALL SELECT doc_id, o, doc_id, n, p FROM slots JOIN meta USING (doc_id) WHERE document_type = 'invoice' AND o IS NULL AND doc_id NOT IN (SELECT invoice_id FROM oc WHERE invoice_id IS NOT NULL)),
  chains AS (SELECT 'CHAIN-' || root AS chain_id, order_id, invoice_id, delivery_note_id, payment_id, coalesce(a.amount, b.amount, c.amount, e.amount) AS total_amount, coalesce(a.vendor, b.vendor, c.vendor, e.vendor) AS vendor,
    CASE WHEN payment_id IS NOT NULL THEN 'completed' WHEN delivery_note_id IS NOT NULL THEN 'delivered' WHEN invoice_id IS NOT NULL THEN 'invoiced' WHEN order_id IS NOT NULL THEN 'ordered' ELSE 'unknown' END AS status
    FROM raw LEFT JOIN meta a ON a.doc_id = order_id LEFT JOIN meta b ON b.doc_id = invoice_id LEFT JOIN meta c ON c.doc_id = delivery_note_id LEFT JOIN meta e ON e.doc_id = payment_id),
  mem AS (SELECT order_id AS doc_id FROM chains UNION ALL SELECT invoice_id FROM chains UNION ALL SELECT delivery_note_id FROM chains UNION ALL SELECT payment_id FROM chains) """


@query("j5_build_chains", CHAINS + "SELECT * FROM chains")
def _(s, d):
    return M.build_chains(meta(s, d))


@query("j6_chain_status", CHAINS + "SELECT status, count(*) AS n FROM chains GROUP BY status")
def _(s, d):
    return M.build_chains(meta(s, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("j7_backfill_amounts", CHAINS + "SELECT chain_id, coalesce(total_amount, CASE WHEN invoice_id % 4 <> 0 THEN invoice_id END)::DOUBLE AS total_amount, total_amount IS NULL AND coalesce(invoice_id % 4 <> 0, false) AS filled FROM chains")
def _(s, d):
    return M.backfill_chain_amounts(M.build_chains(meta(s, d)), archive(s, d)).select("chain_id", "total_amount", "filled")


@query("j8_unmatched", CHAINS + "SELECT doc_id FROM archive WHERE doc_id NOT IN (SELECT doc_id FROM mem WHERE doc_id IS NOT NULL) ORDER BY created_at DESC, doc_id LIMIT 500")
def _(s, d):
    return M.unmatched_documents(archive(s, d), M.build_chains(meta(s, d))).select("doc_id")


@query("j9_chain_coverage", CHAINS + "SELECT (SELECT count(*) FROM chains) AS chains, (SELECT count(*) FROM chains WHERE status = 'completed') AS completed, (SELECT count(DISTINCT doc_id) FROM mem) AS in_chains, (SELECT count(*) FROM archive) AS documents, (SELECT count(*) FROM archive) - (SELECT count(DISTINCT doc_id) FROM mem) AS unmatched")
def _(s, d):
    return M.chain_coverage(archive(s, d), M.build_chains(meta(s, d)))


@query("j10_document_detail", META + "SELECT o.o_orderkey AS doc_id, o.o_totalprice, m.order_number FROM orders o LEFT JOIN (SELECT * FROM meta WHERE document_type <> 'receipt') m ON m.doc_id = o.o_orderkey")
def _(s, d):
    docs = table(s, d, "orders").selectExpr("o_orderkey AS doc_id", "o_totalprice")
    return M.document_detail(docs, meta(s, d).where("document_type <> 'receipt'").select("doc_id", "order_number"))


@query("j11_chains_by_status", CHAINS + "SELECT chain_id, status, row_number() OVER (PARTITION BY status ORDER BY total_amount DESC NULLS LAST, chain_id) AS rank FROM chains QUALIFY rank <= 10")
def _(s, d):
    return M.chains_by_status(M.build_chains(meta(s, d))).select("chain_id", "status", "rank")


@query("j12_attach_results", WITH + "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id // 2 END AS result_id, CASE WHEN doc_id % 3 <> 0 AND doc_id // 2 % 5 = 0 THEN 'r' || doc_id // 2 END AS result FROM archive")
def _(s, d):
    a = archive(s, d)
    titled = a.selectExpr("doc_id", "if(doc_id % 3 = 0, 'Old title', concat('Document #', doc_id div 2)) AS title")
    results = a.where("doc_id % 5 = 0").selectExpr("doc_id AS result_id", "concat('r', doc_id) AS result")
    return M.attach_results(titled, results).select("doc_id", "result_id", "result")


@query("j13_attach_mail_source", WITH + "SELECT '/in/' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN sender END AS sender, CASE WHEN doc_id % 2 = 0 THEN subject END AS subject FROM archive")
def _(s, d):
    a = archive(s, d)
    return M.attach_mail_source(a.selectExpr("concat('/in/', doc_id) AS path"), a.where("doc_id % 2 = 0").selectExpr("concat('/in/', doc_id) AS saved_path", "sender", "subject"))


CACHE = WITH + ", f AS (SELECT * FROM archive WHERE doc_id % 3 = 1), c AS (SELECT * FROM archive WHERE doc_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY doc_id) = 1), r AS (SELECT f.doc_id, c.document_type AS cached_type, c.doc_id IS NOT NULL AS hit FROM f LEFT JOIN c USING (file_hash)) "


def reused(s, d):
    a = archive(s, d)
    return M.reuse_cached(a.where("doc_id % 3 = 1").select("doc_id", "file_hash"), a.where("doc_id % 3 = 0"))


@query("j14_reuse_cached", CACHE + "SELECT doc_id, cached_type, hit FROM r")
def _(s, d):
    return reused(s, d).select("doc_id", "cached_type", "hit")


@query("j14_cache_stats", CACHE + "SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate FROM r")
def _(s, d):
    return M.cache_stats(reused(s, d))


def resolved(s, d):
    catalog = table(s, d, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "upper(c_name) AS name")
    return M.resolve_entities(table(s, d, "orders").selectExpr("o_orderkey AS doc_id", "concat('Customer#', lpad(o_custkey, 9, '0')) AS correspondent"), catalog, "correspondent")


@query("j15_resolve_entities", "SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS entity_id FROM orders")
def _(s, d):
    return resolved(s, d).select("doc_id", "entity_id")


@query("j15_to_create", "SELECT DISTINCT lower('Customer#' || lpad(o_custkey::VARCHAR, 9, '0')) AS name FROM orders WHERE o_custkey % 2 = 1")
def _(s, d):
    return M.to_create(resolved(s, d), "correspondent")


@query("j16_type_paths", "WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey < 5 THEN NULL ELSE p_partkey // 5 END AS parent_id, p_brand AS name FROM part), p(id, path) AS (SELECT id, name FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, p.path || ' > ' || n.name FROM n JOIN p ON n.parent_id = p.id) SELECT id, path FROM p")
def _(s, d):
    return M.type_paths(table(s, d, "part").selectExpr("p_partkey AS id", "if(p_partkey < 5, null, p_partkey div 5) AS parent_id", "p_brand AS name"))


@query("w1_newest_per_key", WITH + "SELECT doc_id, sender, document_type FROM archive WHERE sender IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sender, document_type ORDER BY created_at DESC, doc_id) = 1")
def _(s, d):
    return O.newest_per_key(archive(s, d).where("sender is not null"), ["sender", "document_type"], [F.desc("created_at"), "doc_id"]).select("doc_id", "sender", "document_type")
