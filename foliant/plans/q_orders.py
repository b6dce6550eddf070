"""Queries of bank statements (B*) and orders (O*): Spark renders the files from orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import orders as O
from foliant.operators import statements as B
from foliant.sources.staging import spread
from .base import ARCHIVE, archive, table
from .registry import query

KEY = "struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
CENTS = "cast(round(l_extendedprice * 100) as bigint)"
SIGN = "if(l_returnflag = 'R', '-', '')"
NUMBERED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
AMOUNT = "(round(l_extendedprice, 2) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)::DECIMAL(18,2)"


#: Of each format the line of an order's line, and what stands before and after a file's lines.
FORMS = {
    "MT940": (
        f"concat(':61:', date_format(l_shipdate, 'yyMMdd'), if(l_returnflag = 'R', 'D', 'C'), {CENTS} div 100, ',', lpad({CENTS} % 100, 2, '0'), 'NTRF\\n:86:Platba VS:', l_partkey, '\\n KS:0308 19-123456/0800')",
        "concat(':20:ST', l_orderkey, '\\n:25:0800/123\\n:60F:C240101CZK1000,00\\n')",
        "'\\n:62F:C240131CZK2000,50\\n'",
    ),
    "CAMT053": (
        f"""concat('<Ntry><Amt Ccy="EUR">', {CENTS} div 100, '.', lpad({CENTS} % 100, 2, '0'), '</Amt><CdtDbtInd>', if(l_returnflag = 'R', 'DBIT', 'CRDT'), '</CdtDbtInd><BookgDt><Dt>', date_format(l_shipdate, 'yyyy-MM-dd'), '</Dt></BookgDt><AddtlNtryInf>VS ', l_partkey, '</AddtlNtryInf></Ntry>')""",
        """concat('<?xml version="1.0"?><Document xmlns="urn:iso:std:iso:20022:tech:xsd:camt.053.001.02"><BkToCstmrStmt><Stmt><Id>', l_orderkey, '</Id>')""",
        "'</Stmt></BkToCstmrStmt></Document>'",
    ),
    "ABO": (
        f"concat('075', lpad('123456', 16, '0'), '0800', lpad('', 25, '0'), lpad({CENTS}, 12, '0'), if(l_returnflag = 'R', '1', '2'), lpad(l_partkey, 10, '0'), '0308', lpad('', 10, '0'), date_format(l_shipdate, 'yyMMdd'))",
        "concat('074', lpad('123456', 16, '0'), '0800', '001', '240131\\n')",
        "'\\n'",
    ),
    "CSV": (
        f"concat(date_format(l_shipdate, 'dd.MM.yyyy'), ';', {SIGN}, {CENTS} div 100, ',', lpad({CENTS} % 100, 2, '0'), ';', l_partkey, ';\"text ', l_linenumber, '\"')",
        "if(l_orderkey % 2 = 0, 'Datum;Částka;VS;Popis\\n', 'Buchungstag;Betrag;VS;Verwendungszweck\\n')",
        "'\\n'",
    ),
    "FINSTA": (
        f"concat('<FINSTA05><S61_DATUM>', date_format(l_shipdate, 'dd.MM.yyyy'), '</S61_DATUM><S61_CASTKA>', {CENTS} div 100, ',', lpad({CENTS} % 100, 2, '0'), '</S61_CASTKA><S61_CD_INDIK>', if(l_returnflag = 'R', 'D', 'C'), '</S61_CD_INDIK><PART_ACCNO>123</PART_ACCNO><PART_BANK_ID>0800</PART_BANK_ID><S86_VARSYMOUR>', l_partkey, '</S86_VARSYMOUR></FINSTA05>')",
        "'<FINSTA><FINSTA03><S28_CISLO_VYPISU>1</S28_CISLO_VYPISU>'",
        "'</FINSTA03></FINSTA>'",
    ),
}
NAMES = list(FORMS)


def rendered(s, d, line: str, head: str, foot: str, where: str = "true"):
    """(path, content): a file for each order with a line for each of its lines, rendered where they are gathered: lines are few bytes, texts much work."""
    rows = spread(table(s, d, "lineitem").where(where), "l_orderkey").selectExpr("l_orderkey", f"{KEY} AS k", f"{line} AS line")
    body = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.select(F.col("l_orderkey").cast("string").alias("path"), F.concat(F.expr(head), "body", F.expr(foot)).alias("content"))


def mt940(s, d):
    return rendered(s, d, *FORMS["MT940"])


def camt(s, d):
    return rendered(s, d, *FORMS["CAMT053"])


def abo(s, d):
    return rendered(s, d, *FORMS["ABO"])


def csv(s, d):
    return rendered(s, d, *FORMS["CSV"])


def finsta(s, d):
    return rendered(s, d, *FORMS["FINSTA"])


def mixed(s, d):
    """Files of all formats, which the order's key decides, and notes, which have none; lines are read and dealt once."""
    parts = ["CASE l_orderkey % 6 " + " ".join(f"WHEN {k} THEN {form[part]}" for k, form in enumerate(FORMS.values())) + " END" for part in range(3)]
    notes = table(s, d, "orders").where("o_orderkey % 6 = 5").selectExpr("cast(o_orderkey as string) AS path", "concat('note ', o_orderkey) AS content")
    return rendered(s, d, *parts, where="l_orderkey % 6 BETWEEN 0 AND 4").unionByName(notes)


TX_SQL = f"SELECT l_orderkey::VARCHAR AS path, {NUMBERED} AS n, l_shipdate::DATE AS date, {AMOUNT} AS amount, l_partkey::VARCHAR AS variable_symbol FROM lineitem"


def tx(df):
    return df.select("path", "n", "date", "amount", "variable_symbol")


@query("b1_detect_format", "SELECT DISTINCT l_orderkey::VARCHAR AS path, ['MT940', 'CAMT053', 'ABO', 'CSV', 'FINSTA'][(l_orderkey % 6 + 1)::INT] AS format FROM lineitem WHERE l_orderkey % 6 < 5 UNION ALL SELECT o_orderkey::VARCHAR, 'UNKNOWN' FROM orders WHERE o_orderkey % 6 = 5")
def _(s, d):
    return mixed(s, d).select("path", B.detect_format(F.col("content")).alias("format"))


@query("b2_mt940", TX_SQL)
def _(s, d):
    return tx(B.mt940_transactions(mt940(s, d)))


@query("b2_mt940_balances", "SELECT DISTINCT l_orderkey::VARCHAR AS path, 'ST' || l_orderkey AS statement_id, 1000::DECIMAL(18,2) AS opening, 2000.5::DECIMAL(18,2) AS closing FROM lineitem")
def _(s, d):
    return B.mt940_balances(mt940(s, d)).select("path", "statement_id", "opening", "closing")


@query("b3_camt", TX_SQL)
def _(s, d):
    return tx(B.camt_transactions(camt(s, d)))


@query("b4_abo", TX_SQL.replace("l_partkey::VARCHAR AS", "CASE WHEN l_partkey > 0 THEN lpad(l_partkey::VARCHAR, 10, '0') END AS"))
def _(s, d):
    return tx(B.abo_transactions(abo(s, d)))


@query("b5_csv", TX_SQL)
def _(s, d):
    return tx(B.csv_transactions(csv(s, d)))


@query("b6_finsta", TX_SQL.replace("l_partkey::VARCHAR AS", "CASE WHEN l_partkey > 0 THEN l_partkey::VARCHAR END AS"))
def _(s, d):
    return tx(B.finsta_transactions(finsta(s, d)))


@query("b7_bank_name", "SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'Komerční banka' WHEN 1 THEN 'ČSOB' WHEN 2 THEN 'Fio banka' END AS bank_name FROM orders")
def _(s, d):
    code = F.expr("CASE o_custkey % 4 WHEN 0 THEN '0100' WHEN 1 THEN '0300' WHEN 2 THEN '2010' ELSE '9999' END")
    return B.with_bank_name(table(s, d, "orders"), code).select("o_orderkey", "bank_name")


TOTALS = f"SELECT l_orderkey::VARCHAR AS path, count(*) AS n, sum({AMOUNT}) AS net_change, coalesce(sum(-{AMOUNT}) FILTER (l_returnflag = 'R'), 0) AS debits, coalesce(sum({AMOUNT}) FILTER (l_returnflag <> 'R'), 0) AS credits, min(l_shipdate)::DATE AS date_from, max(l_shipdate)::DATE AS date_to FROM lineitem WHERE l_orderkey % 6 < 5 GROUP BY ALL"


@query("b8_statement_totals", TOTALS)
def _(s, d):
    return B.statement_totals(B.read_transactions(mixed(s, d)))


@query("b9_statement_record", f"SELECT path, 'Statement Fio ' || strftime(date_from, '%Y-%m-%d') || ' - ' || strftime(date_to, '%Y-%m-%d') AS title, 'bank,statement,Rok_' || year(date_to) AS tags, 'Fio' AS correspondent, n FROM ({TOTALS.replace('WHERE l_orderkey % 6 < 5', '')})")
def _(s, d):
    out = B.statement_record(B.statement_totals(B.abo_transactions(abo(s, d))), "Fio")
    return out.select("path", "title", F.array_join("tags", ",").alias("tags"), "correspondent", "n")


def exports(s, d):
    """An order export for each customer in one of three languages and three delimiters."""
    heads = [(",", "Order Number,Order Date,ASIN,Title,Quantity,Item Price,VAT Rate,Order Total"), (";", "Bestellnummer;Bestelldatum;ASIN;Titel;Menge;Artikelpreis;USt.-Satz;Gesamtbetrag"), ("\\t", "Číslo objednávky\\tDatum objednávky\\tASIN\\tNázev\\tMnožství\\tCena\\tSazba DPH\\tCelkem")]
    rows = spread(table(s, d, "lineitem").join(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey")
    cells = "cast(o_orderkey as string), date_format(o_orderdate, 'dd.MM.yyyy'), if(l_partkey % 7 = 0, 'N/A', concat('B', l_partkey)), if(l_partkey % 7 = 0, '-', concat('Part ', l_partkey)), cast(cast(l_quantity as int) as string), replace(concat(CENTS div 100, '.', lpad(CENTS % 100, 2, '0')), '.', if(o_custkey % 3 = 0, '.', ',')), if(o_custkey % 3 = 1, '0,19', '19%'), if(o_orderkey % 2 = 0, '0', '123')".replace("CENTS", CENTS)
    line = "concat_ws(CASE o_custkey % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE '\\t' END, " + cells + ")"
    body = rows.selectExpr("o_custkey", f"struct(o_orderkey, {KEY[7:-1]}) AS k", f"{line} AS line").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = "CASE o_custkey % 3 " + " ".join(f"WHEN {k} THEN '{h}\\n'" for k, (_, h) in enumerate(heads)) + " END"
    return body.select(F.concat(F.lit("orders_from_"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("path"), F.concat(F.expr(head), "body").alias("content"))


ITEMS = """WITH i AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row, l_partkey, l_quantity::INT AS quantity, round(l_extendedprice, 2)::DECIMAL(18,2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey) """


@query("o1_is_order_export", "SELECT DISTINCT 'orders_from_' || o_custkey || '.csv' AS path, true AS is_export FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def _(s, d):
    return exports(s, d).select("path", O.is_order_export(F.col("path"), F.split("content", "\n")[0]).alias("is_export"))


@query("o2_detect_delimiter", "SELECT DISTINCT 'orders_from_' || o_custkey || '.csv' AS path, CASE o_custkey % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS delimiter FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def _(s, d):
    return exports(s, d).select("path", O.detect_delimiter(F.split("content", "\n")[0]).alias("delimiter"))


@query("o3_header_language", "SELECT DISTINCT 'orders_from_' || o_custkey || '.csv' AS path, CASE o_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'cs' END AS language FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def _(s, d):
    head = F.split("content", "\n")[0]
    return exports(s, d).select("path", O.detect_header_language(F.split(head, "[,;\t]")).alias("language"))


@query("o4_canonical_columns", ITEMS + "SELECT 'orders_from_' || o_custkey || '.csv' AS path, row, o_orderkey::VARCHAR AS order_number, CASE WHEN l_partkey % 7 <> 0 THEN 'B' || l_partkey END AS asin, CASE WHEN l_partkey % 7 <> 0 THEN 'Part ' || l_partkey END AS title FROM i")
def _(s, d):
    return O.read_orders(exports(s, d)).select("path", "row", "order_number", "asin", "title")


@query("o5_locale_values", ITEMS + "SELECT 'orders_from_' || o_custkey || '.csv' AS path, row, o_orderdate::DATE AS order_date, quantity, price, 19::DECIMAL(5,2) AS vat_rate FROM i")
def _(s, d):
    return O.locale_values(O.read_orders(exports(s, d))).select("path", "row", "order_date", "quantity", "price", "vat_rate")


@query("o6_group_orders", ITEMS + "SELECT o_orderkey::VARCHAR AS order_number, any_value(o_orderdate)::DATE AS order_date, coalesce(string_agg('B' || l_partkey, ',' ORDER BY row) FILTER (l_partkey % 7 <> 0), '') AS asins FROM i GROUP BY o_orderkey")
def _(s, d):
    g = O.group_orders(O.locale_values(O.read_orders(exports(s, d))))
    return g.select("order_number", "order_date", F.array_join(F.transform("items", lambda x: x["asin"]), ",").alias("asins"))


@query("o7_row_range", ITEMS + "SELECT 'orders_from_' || o_custkey || '.csv' AS path, row FROM i WHERE row BETWEEN 3 AND 7")
def _(s, d):
    return O.row_range(O.read_orders(exports(s, d)), 3, 7).select("path", "row")


@query("o8_order_totals", ITEMS + "SELECT o_orderkey::VARCHAR AS order_number, CASE WHEN o_orderkey % 2 = 1 THEN 123 ELSE coalesce(sum(quantity * price) FILTER (l_partkey % 7 <> 0), 0) END::DECIMAL(18,2) AS total, count(*) FILTER (l_partkey % 7 <> 0) AS n_items FROM i GROUP BY o_orderkey")
def _(s, d):
    return O.order_totals(O.group_orders(O.locale_values(O.read_orders(exports(s, d))))).drop("net")


@query("o8_order_summary", ITEMS + "SELECT o_orderkey::VARCHAR AS order_number, CASE WHEN o_orderkey % 2 = 1 THEN 123 ELSE coalesce(sum(quantity * price) FILTER (l_partkey % 7 <> 0), 0) + 4.5 - o_orderkey % 3 END::DECIMAL(18,2) AS gross, (100 + 4.5 - o_orderkey % 3)::DECIMAL(18,2) AS net, 19::DECIMAL(18,2) AS vat, 4.5::DECIMAL(18,2) AS shipping, (-(o_orderkey % 3))::DECIMAL(18,2) AS promotion FROM i GROUP BY o_orderkey")
def _(s, d):
    g = O.group_orders(O.locale_values(O.read_orders(exports(s, d))))
    key = F.col("order_number").cast("long")
    return O.order_summary(g.withColumns({"subtotal": F.lit(100), "vat": F.lit(19), "shipping": F.lit("4.5").cast("decimal(4,2)"), "promotion": -(key % 3)}))


def items(s, d):
    return table(s, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS n", "l_partkey", "l_quantity AS quantity", "l_extendedprice AS price", "round(l_discount * 100) AS discount", "round(l_tax * 100) AS rate")


LINE = "WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey, round(l_tax * 100)::INT AS rate, round(l_quantity::DECIMAL(12,2) * l_extendedprice::DECIMAL(12,2) * ((100 - round(l_discount * 100)::DECIMAL(5,2)) * 0.01::DECIMAL(3,2)), 2)::DECIMAL(18,2) AS net FROM lineitem), v AS (SELECT *, round(net * (rate::DECIMAL(5,2) * 0.01::DECIMAL(3,2)), 2)::DECIMAL(18,2) AS vat FROM l) "


@query("o9_line_amounts", LINE + "SELECT doc_id, n, l_partkey, net, vat, (net + vat)::DECIMAL(18,2) AS gross FROM v")
def _(s, d):
    return O.line_amounts(items(s, d)).select("doc_id", "n", "l_partkey", "net", "vat", "gross")


@query("o10_document_totals", LINE + "SELECT doc_id, sum(net) AS net, sum(vat) AS vat, sum(net + vat) AS gross FROM v GROUP BY doc_id")
def _(s, d):
    return O.document_totals(O.line_amounts(items(s, d)))


@query("o11_vat_breakdown", LINE + "SELECT doc_id, rate, sum(net) AS base, sum(vat) AS vat FROM v GROUP BY doc_id, rate")
def _(s, d):
    return O.vat_breakdown(O.line_amounts(items(s, d))).withColumn("rate", F.col("rate").cast("int"))


@query("o12_processing_stats", "SELECT count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus <> 'F') AS failed, sum(2)::BIGINT AS n_rows, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS amount FROM orders")
def _(s, d):
    return O.processing_stats(table(s, d, "orders").selectExpr("o_orderstatus = 'F' AS ok", "2 AS n_rows", "o_totalprice AS amount"))


@query("o13_einvoice_candidates", f"WITH {ARCHIVE} SELECT doc_id FROM archive WHERE document_type IN ('invoice', 'receipt') AND NOT synced")
def _(s, d):
    a = archive(s, d)
    return O.einvoice_candidates(a, a.where("synced"), ["invoice", "receipt"]).select("doc_id")
