"""Queries of field extraction (E*): Spark renders documents from orders and lines, the operators read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import values as V
from foliant.functions.names import person_of
from foliant.operators import extract as O
from foliant.sources.staging import spread
from .base import ARCHIVE, archive, table
from .registry import query

WITH = f"WITH {ARCHIVE} "
#: cents as 1 234,56
CZECH = "concat(if({c} >= 100000, concat({c} div 100000, ' '), ''), if({c} >= 100000, lpad({c} div 100 % 1000, 3, '0'), cast({c} div 100 as string)), ',', lpad({c} % 100, 2, '0'))"
CENTS = "cast(round(o_totalprice * 100) as bigint)"


def letters(s, d):
    """A text for each order that names its numbers, parties, dates and amounts."""
    text = f"""concat(CASE o_orderpriority WHEN '1-URGENT' THEN concat('FAKTURA č. F', o_orderkey) WHEN '2-HIGH' THEN 'OBJEDNÁVKA' WHEN '3-MEDIUM' THEN concat('Dodací list č. DL', o_orderkey) ELSE 'Platba' END,
      '\\nObjednávka č. PO-', o_custkey, '\\nVariabilní symbol: ', lpad(o_orderkey, 8, '0'), '\\nFirma ', o_custkey, ' s.r.o.\\nIČO: ', lpad(o_custkey, 8, '0'), ' DIČ: CZ', lpad(o_custkey, 8, '0'),
      '\\nDatum vystavení: ', date_format(o_orderdate, 'd.M.yyyy'), '\\nDatum splatnosti: ', date_format(date_add(o_orderdate, 14), 'yyyy-MM-dd'), '\\nÚčet 19-2000145399/0800', '\\nSazba 21 %\\nCelkem: ', {CZECH.format(c=CENTS)}, ' Kč\\n')"""
    return archive(s, d).join(table(s, d, "orders").selectExpr("o_orderkey AS doc_id", f"{text} AS text"), "doc_id")


@query("e1_identifiers", WITH + "SELECT doc_id, CASE WHEN document_type IN ('order', 'invoice', 'delivery_note') THEN 'PO-' || o_custkey END AS order_number, CASE WHEN document_type = 'invoice' THEN 'F' || doc_id END AS invoice_number, CASE WHEN document_type = 'delivery_note' THEN 'DL' || doc_id END AS delivery_note_number, CASE WHEN document_type IN ('invoice', 'payment') THEN lpad(doc_id::VARCHAR, 8, '0') END AS variable_symbol FROM archive")
def _(s, d):
    fixed = letters(s, d)
    return O.extract_identifiers(fixed)


@query("e2_references", WITH + "SELECT doc_id, concat_ws(',', 'PO-' || o_custkey, CASE document_type WHEN 'invoice' THEN 'F' || doc_id WHEN 'delivery_note' THEN 'DL' || doc_id END, lpad(doc_id::VARCHAR, 8, '0')) AS refs FROM archive")
def _(s, d):
    fixed = letters(s, d)
    return fixed.select("doc_id", F.array_join(O.extract_references(F.col("text")), ",").alias("refs"))


@query("e3_company", "SELECT o_orderkey AS doc_id, lpad(o_custkey::VARCHAR, 8, '0') AS company_id, 'CZ' || lpad(o_custkey::VARCHAR, 8, '0') AS vat_id, 'Firma ' || o_custkey || ' s.r.o.' AS vendor FROM orders")
def _(s, d):
    return letters(s, d).select("doc_id", *O.extract_company(F.col("text")))


@query("e4_normalize_amount", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE round(o_totalprice, 2)::DECIMAL(18,2) END AS amount FROM orders")
def _(s, d):
    whole, part = f"{CENTS} div 100", f"lpad({CENTS} % 100, 2, '0')"
    raw = f"CASE o_orderkey % 5 WHEN 0 THEN {CZECH.format(c=CENTS)} WHEN 1 THEN replace({CZECH.format(c=CENTS)}, ' ', '.') WHEN 2 THEN replace(replace(replace({CZECH.format(c=CENTS)}, ',', ';'), ' ', ','), ';', '.') WHEN 3 THEN concat({whole}, '.', {part}) ELSE '12.5x' END"
    return table(s, d, "orders").select("o_orderkey", V.normalize_amount(F.expr(raw)).alias("amount"))


@query("e5_normalize_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate::DATE END AS date FROM orders")
def _(s, d):
    months = "element_at(array(" + ", ".join(f"'{m}'" for m in V.MONTHS) + "), month(o_orderdate))"
    raw = f"CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'd.M.yyyy') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 2 THEN date_format(o_orderdate, 'dd/MM/yy') WHEN 3 THEN concat(day(o_orderdate), '. ', {months}, ' ', year(o_orderdate)) ELSE '31.02.2024' END"
    return table(s, d, "orders").select("o_orderkey", V.normalize_date(F.expr(raw)).alias("date"))


@query("e6_dates", "SELECT o_orderkey AS doc_id, o_orderdate::DATE AS issue_date, (o_orderdate + INTERVAL 14 DAY)::DATE AS due_date, NULL::DATE AS delivery_date, NULL::DATE AS payment_date FROM orders")
def _(s, d):
    return letters(s, d).select("doc_id", *O.extract_dates(F.col("text")))


@query("e7_amounts", "SELECT o_orderkey AS doc_id, round(o_totalprice, 2)::DECIMAL(18,2) AS total, 21 AS vat_rate, round(round(o_totalprice, 2) * 21 / 121, 2)::DECIMAL(18,2) AS vat, (round(o_totalprice, 2)::DECIMAL(18,2) - round(round(o_totalprice, 2) * 21 / 121, 2)::DECIMAL(18,2))::DECIMAL(18,2) AS base FROM orders")
def _(s, d):
    return O.extract_amounts(letters(s, d).select("doc_id", "text")).drop("text")


TOTAL = "round(amount, 2)::DECIMAL(18,2)"
VAT = "round(round(amount, 2) * 21 / 121, 2)::DECIMAL(18,2)"
FIELDS = {
    "document_type": "document_type", "sender_name": "CASE WHEN sender IS NOT NULL THEN 'user' || o_custkey % 97 END", "sender_address": "sender", "sender_domain": "CASE WHEN sender IS NOT NULL THEN 'd' || o_custkey % 13 || '.example.com' END",
    "recipient_name": "'Jan'", "subject": "subject", "year": "year(created_at)", "month": "month(created_at)", "quarter": "quarter(created_at)",
    "order_number": "'PO-' || o_custkey", "invoice_number": "CASE document_type WHEN 'invoice' THEN 'F' || doc_id END", "delivery_note_number": "CASE document_type WHEN 'delivery_note' THEN 'DL' || doc_id END", "variable_symbol": "lpad(doc_id::VARCHAR, 8, '0')",
    "company_id": "lpad(o_custkey::VARCHAR, 8, '0')", "vat_id": "'CZ' || lpad(o_custkey::VARCHAR, 8, '0')", "vendor": "'Firma ' || o_custkey || ' s.r.o.'",
    "issue_date": "created_at::DATE", "due_date": "(created_at + INTERVAL 14 DAY)::DATE", "delivery_date": "NULL::DATE", "payment_date": "NULL::DATE",
    "total": TOTAL, "vat_rate": "21", "vat": VAT, "base": f"({TOTAL} - {VAT})::DECIMAL(18,2)", "currency": "'CZK'", "payment_status": "NULL::VARCHAR", "direction": "'expense'", "account": "'19-2000145399/0800'", "period": "NULL::VARCHAR",
    "mail_date": "created_at",
}


@query("e8_fields31", WITH + "SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in FIELDS.items()) + " FROM archive")
def _(s, d):
    wide = O.fields31(letters(s, d), F.col("sender"), F.lit("Jan <jan@x.cz>"), F.col("subject"), F.col("created_at"))
    return wide.select("doc_id", *FIELDS)


BASIC = WITH + ", a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN subject END AS subject, 'x' AS category FROM archive), b AS (SELECT doc_id, 'enhanced' AS subject, document_type AS category, amount FROM archive WHERE doc_id % 3 = 0) "


@query("e9_merge_fields", BASIC + "SELECT a.doc_id, coalesce(a.subject, b.subject) AS subject, b.category, b.amount FROM a LEFT JOIN b USING (doc_id)")
def _(s, d):
    a = archive(s, d)
    return O.merge_fields(a.selectExpr("doc_id", "if(doc_id % 2 = 0, subject, null) AS subject", "'x' AS category"), a.where("doc_id % 3 = 0").selectExpr("doc_id", "'enhanced' AS subject", "document_type AS category", "amount"))


@query("e10_extraction_confidence", WITH + "SELECT doc_id, ((CASE WHEN sender IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN ai_confidence IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN ocr_confidence IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END) / 12)::DOUBLE AS confidence FROM archive")
def _(s, d):
    found = archive(s, d).withColumn("direction", F.when(F.col("doc_id") % 2 == 0, "income").otherwise("unknown"))
    return found.select("doc_id", O.extraction_confidence({"sender": 3, "ai_confidence": 2, "ocr_confidence": 5, "direction": 2}).alias("confidence"))


@query("e11_provenance", WITH + "SELECT doc_id, 'sender' AS field, sender AS value, 0.9::DOUBLE AS confidence, 'regex' AS source FROM archive WHERE sender IS NOT NULL UNION ALL SELECT doc_id, 'subject', subject, 0.85, 'regex' FROM archive")
def _(s, d):
    return O.with_provenance(archive(s, d), {"sender": 0.9, "subject": 0.85})


@query("e11_missing_fields", WITH + "SELECT doc_id, 'sender' AS field FROM archive WHERE sender IS NULL UNION ALL SELECT doc_id, 'ai_confidence' FROM archive WHERE ai_confidence IS NULL")
def _(s, d):
    return O.missing_fields(archive(s, d), ["sender", "ai_confidence"])


#: cents as 1 234,56 in DuckDB
CZECH_SQL = "(CASE WHEN {c} >= 100000 THEN {c} // 100000 || ' ' || lpad(({c} // 100 % 1000)::VARCHAR, 3, '0') ELSE ({c} // 100)::VARCHAR END || ',' || lpad(({c} % 100)::VARCHAR, 2, '0'))"
PLATE = "concat({k} % 9 + 1, 'A', {k} % 10, ' ', lpad({n}, 4, '0'))"


@query("e12_quick_facts", f"""WITH o AS (SELECT *, round(o_totalprice * 100)::BIGINT AS c, 1000 + o_orderkey % 9000 AS l FROM orders)
SELECT o_orderkey AS doc_id, {CZECH_SQL.format(c='l')} || ';' || {CZECH_SQL.format(c='c')} AS amounts, strftime(o_orderdate, '%-d/%-m/%Y') AS dates,
  CASE WHEN o_orderpriority = '5-LOW' THEN {PLATE.format(k='o_orderkey', n='(o_orderkey % 10000)::VARCHAR')} END AS plate, CASE WHEN o_orderpriority = '5-LOW' THEN (l / 100)::DECIMAL(18,2) END AS litres FROM o""")
def _(s, d):
    litres = "(1000 + o_orderkey % 9000)"
    text = f"concat('Datum ', date_format(o_orderdate, 'd/M/yyyy'), '\\nSPZ ', {PLATE.format(k='o_orderkey', n='cast(o_orderkey % 10000 as string)')}, '\\nNatankováno ', {CZECH.format(c=litres)}, ' l\\nCelkem: ', {CZECH.format(c=CENTS)}, ' Kč\\n')"
    docs = archive(s, d).join(table(s, d, "orders").selectExpr("o_orderkey AS doc_id", f"{text} AS text"), "doc_id")
    return docs.select("doc_id", *O.quick_facts(F.col("text"), F.col("document_type")))


def invoices(s, d):
    """Invoice texts with a table of each order's lines."""
    cents = "cast(round(l_extendedprice * 100) as bigint)"
    line = f"concat(l_linenumber, '. Part ', l_partkey, ' ', cast(l_quantity as int), ' ks ', lpad('', 0, ' '), '21 % ', {CZECH.format(c=cents)}, ' ', {CZECH.format(c=f'(2 * {cents})')}, ' ', {CZECH.format(c=f'(3 * {cents})')})"
    rows = spread(table(s, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id"), "doc_id").selectExpr("doc_id", "struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k", f"{line} AS line")
    body = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.select("doc_id", F.concat(F.lit("Invoice\nPoložky:\n"), "body", F.lit("\nCelkem: 9 999,00 Kč\n")).alias("text"))


LINES = "WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_number, 'Part ' || l_partkey AS part, l_quantity::DOUBLE AS quantity, (2 * round(l_extendedprice, 2))::DECIMAL(18,2) AS net, round(l_extendedprice, 2)::DECIMAL(18,2) AS vat, (3 * round(l_extendedprice, 2))::DECIMAL(18,2) AS gross FROM lineitem) "


@query("e13_invoice_lines", LINES + "SELECT doc_id, line_number, part AS description, quantity, 21 AS vat_rate, vat AS unit_price, net, vat, gross FROM l")
def _(s, d):
    return O.invoice_lines(invoices(s, d))


@query("e14_invoice_summary", LINES + "SELECT o_orderkey AS doc_id, coalesce(n, 0) AS n_lines, coalesce(net, 0)::DECIMAL(18,2) AS net, coalesce(vat, 0)::DECIMAL(18,2) AS vat, coalesce(gross, 0)::DECIMAL(18,2) AS gross FROM orders LEFT JOIN (SELECT doc_id, count(*) AS n, sum(net) AS net, sum(vat) AS vat, sum(gross) AS gross FROM l GROUP BY doc_id) ON doc_id = o_orderkey")
def _(s, d):
    return O.invoice_summary(table(s, d, "orders").selectExpr("o_orderkey AS doc_id"), O.invoice_lines(invoices(s, d))).drop("confidence")


@query("e15_invoice_confidence", "SELECT o_orderkey AS doc_id, CASE WHEN n IS NULL THEN 0 ELSE least(100, 50 + least(5 * n, 30) + 10 + least(5 * n, 10)) END AS confidence FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey")
def _(s, d):
    return O.invoice_summary(table(s, d, "orders").selectExpr("o_orderkey AS doc_id"), O.invoice_lines(invoices(s, d))).select("doc_id", "confidence")


@query("e16_invoice_subject", LINES + "SELECT doc_id, string_agg(part, ', ' ORDER BY line_number) FILTER (line_number <= 3) || CASE WHEN count(*) > 3 THEN ' (' || count(*) || ')' ELSE '' END AS subject FROM l GROUP BY doc_id")
def _(s, d):
    docs = invoices(s, d)
    return O.invoice_subject(docs, O.invoice_lines(docs))


@query("e17_detect_einvoice", "SELECT o_orderkey AS doc_id, o_orderkey % 2 = 0 AS is_einvoice, CASE WHEN o_orderkey % 2 = 0 THEN '6.0.' || o_orderkey % 3 END AS version FROM orders")
def _(s, d):
    text = F.expr("if(o_orderkey % 2 = 0, concat('<ISDOC version=\"6.0.', o_orderkey % 3, '\">'), 'plain')")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), *O.detect_einvoice(text)[:2])


def statements(s, d):
    """A statement text for each order, a two-line transaction for each of its lines."""
    cents = "cast(round(l_extendedprice * 100) as bigint)"
    tx = f"concat(date_format(l_shipdate, 'd.M.yyyy'), ' Firma 123456/0800\\n  platba VS: ', l_partkey, ' KS 0308 ', if(l_returnflag = 'R', '-', '+'), {CZECH.format(c=cents)})"
    rows = spread(table(s, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id"), "doc_id").selectExpr("doc_id", "struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k", f"{tx} AS line")
    body = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.select("doc_id", F.concat(F.lit("Výpis\nPočáteční zůstatek: 1 000,00\nDatum Popis Částka\n"), "body", F.lit("\nCelkem\n")).alias("text"))


@query("e18_statement_lines", "SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_shipdate::DATE AS date, (round(l_extendedprice, 2) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)::DECIMAL(18,2) AS amount, CASE WHEN l_returnflag = 'R' THEN 'outgoing' ELSE 'incoming' END AS direction, '123456/0800' AS account, l_partkey::VARCHAR AS vs, '0308' AS ks, NULL::VARCHAR AS ss FROM lineitem")
def _(s, d):
    return O.statement_lines(statements(s, d))


@query("e19_statement_summary", "SELECT l_orderkey AS doc_id, coalesce(sum(round(l_extendedprice, 2)::DECIMAL(18,2)) FILTER (l_returnflag <> 'R'), 0)::DECIMAL(18,2) AS incoming, coalesce(sum(round(l_extendedprice, 2)::DECIMAL(18,2)) FILTER (l_returnflag = 'R'), 0)::DECIMAL(18,2) AS outgoing, 1000::DECIMAL(18,2) AS opening, (1000 + sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * round(l_extendedprice, 2)::DECIMAL(18,2)))::DECIMAL(18,2) AS closing, count(*) AS n, least(100, 40 + least(3 * count(*), 30) + least(2 * count(*), 20) + least(count(*), 10))::INT AS confidence FROM lineitem GROUP BY ALL")
def _(s, d):
    docs = statements(s, d)
    return O.statement_summary(docs, O.statement_lines(docs))


def receipts(s, d):
    cents = "cast(round(l_extendedprice * 100) as bigint)"
    line = f"concat('Zboží', l_partkey, ' ', cast(l_quantity as int), ' ks ', {CZECH.format(c=cents)})"
    rows = spread(table(s, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id"), "doc_id").selectExpr("doc_id", "struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k", f"{line} AS line", f"{cents} AS c")
    body = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"), F.sum("c").alias("c"))
    total = F.expr("concat(c div 100, ',', lpad(c % 100, 2, '0'))")
    return body.select("doc_id", F.concat(F.lit("Obchod\nÚčtenka\n"), "body", F.lit("\nCelkem: "), total, F.lit("\nFIK: 0123456789abcdef-01\n")).alias("text"))


@query("e20_receipt_lines", "SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_number, 'Zboží' || l_partkey AS description, l_quantity::DOUBLE AS quantity, (((2 * round(l_extendedprice * 100)::BIGINT + l_quantity::BIGINT) // (2 * l_quantity::BIGINT)) / 100)::DECIMAL(18,2) AS price, round(l_extendedprice, 2)::DECIMAL(18,2) AS total FROM lineitem")
def _(s, d):
    return O.receipt_lines(receipts(s, d))


@query("e21_receipt_summary", "SELECT l_orderkey AS doc_id, sum(round(l_extendedprice, 2)::DECIMAL(18,2))::DECIMAL(18,2) AS total, 0::DECIMAL(18,2) AS vat_12, round(sum(round(l_extendedprice, 2)::DECIMAL(18,2))::DOUBLE * 21 / 121, 2)::DECIMAL(18,2) AS vat_21, '0123456789ABCDEF-01' AS fik, NULL::VARCHAR AS bkp, least(100, 50 + least(5 * count(*), 30) + 20)::INT AS confidence FROM lineitem GROUP BY ALL")
def _(s, d):
    docs = receipts(s, d)
    return O.receipt_summary(docs, O.receipt_lines(docs))


HTML = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<nav\b.*?</nav\s*>', ' ', 'g'), '(?is)<footer\b.*?</footer\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))"


@query("e22_html_to_text", f"SELECT page_id, md5(substr({HTML}, 1, 50000)) AS digest FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.md5(O.html_to_text(F.col("html"))).alias("digest"))


@query("e23_corpus_documents", f"SELECT substr(md5(url || trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))), 1, 16) AS id, url FROM pages WHERE length(substr({HTML}, 1, 50000)) > 200 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1")
def _(s, d):
    return O.corpus_documents(table(s, d, "pages")).select("id", "url")


@query("e24_document_title", WITH + "SELECT doc_id, document_type || '_' || strftime(created_at, '%Y-%m-%d') || '_scan.' || doc_id AS title FROM archive")
def _(s, d):
    return archive(s, d).select("doc_id", O.document_title(F.col("document_type"), F.col("created_at"), F.concat(F.lit("scan."), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("title"))


@query("e25_validate_extractions", WITH + "SELECT doc_id, concat_ws('; ', CASE WHEN sender IS NULL THEN 'sender: missing' END, CASE WHEN amount < 50000 THEN 'amount: below 50000' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'o_orderstatus: not allowed' END) AS errors, sender IS NOT NULL AND amount >= 50000 AND o_orderstatus IN ('O', 'F') AS is_valid FROM archive")
def _(s, d):
    return O.validate_extractions(archive(s, d), ["sender"], {"amount": 50000}, {"o_orderstatus": ["O", "F"]}).select("doc_id", "errors", "is_valid")


@query("e26_backfill_amount", WITH + "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id::DOUBLE WHEN doc_id % 3 = 0 THEN amount END AS amount, CASE WHEN doc_id % 4 <> 0 THEN 'metadata' WHEN doc_id % 3 = 0 THEN 'extracted' ELSE 'none' END AS origin FROM archive")
def _(s, d):
    a = archive(s, d)
    return O.backfill_amount(a, a.where("doc_id % 3 = 0"))


@query("e27_persons", WITH + "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Jan Novák ' || doc_id ELSE 'user' || o_custkey % 97 END AS person FROM archive WHERE sender IS NOT NULL")
def _(s, d):
    header = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"Jan Novák '), F.col("doc_id").cast("string"), F.lit('" <'), "sender", F.lit(">"))).otherwise(F.col("sender"))
    return archive(s, d).where("sender is not null").select("doc_id", person_of(header).alias("person"))


@query("e28_einvoice_data", "SELECT o_orderkey AS doc_id, md5(o_orderkey::VARCHAR) AS uuid, 'F' || o_orderkey AS number, lpad(o_orderkey::VARCHAR, 8, '0') AS symbol, '19-2000145399/0800' AS account, round(round(o_totalprice, 2) * 0.21::DOUBLE / 1.21::DOUBLE, 2)::DECIMAL(18,2) AS vat, (round(o_totalprice, 2)::DECIMAL(18,2) - round(round(o_totalprice, 2) * 0.21::DOUBLE / 1.21::DOUBLE, 2)::DECIMAL(18,2))::DECIMAL(18,2) AS net FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(s, d):
    return letters(s, d).where("document_type = 'invoice'").select("doc_id", *O.einvoice_data(F.col("text"), F.col("doc_id")))
