"""Bank statement files: format detection and transactions of MT940, CAMT.053, ABO, CSV and FINSTA.

files is (path, content), one row a file. Records are split and read by column expressions;
amounts are decimals. A file's transactions are numbered by their order in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.values import MONEY, all_but_first, cells, found, normalize_amount, normalize_date
from foliant.sources.staging import once

#: Codes of national banks; fixed values.
BANKS = {"0100": "Komerční banka", "0300": "ČSOB", "0600": "Moneta Money Bank", "0800": "Česká spořitelna", "2010": "Fio banka", "2700": "UniCredit Bank", "3030": "Air Bank", "5500": "Raiffeisenbank"}
TX = ["path", "n", "date", "amount", "type", "currency", "account", "variable_symbol", "constant_symbol", "specific_symbol", "description"]


def detect_format(content: Column) -> Column:
    head = F.lower(F.split(F.ltrim(content), "\n", 2)[0])
    return (
        F.when(content.contains(":20:") & content.contains(":25:") & content.contains(":60F:"), "MT940")
        .when(content.contains("<Document xmlns=") & content.contains("camt.053"), "CAMT053")
        .when(content.contains("<FINSTA"), "FINSTA")
        .when(content.startswith("074"), "ABO")
        .when((F.size(F.split(content, "\n")) > 1) & head.rlike("[;,]") & head.rlike("datum|date|amount|částka|betrag"), "CSV")
        .otherwise("UNKNOWN")
    )


def _kind(amount: Column) -> Column:
    return F.when(amount < 0, "DEBIT").otherwise("CREDIT")


def _yymmdd(raw: Column) -> Column:
    """Two-digit years from 69 on are of the last century."""
    return F.try_to_date(F.concat(F.when(F.substring(raw, 1, 2) >= "69", "19").otherwise("20"), raw), "yyyyMMdd")


def _symbol(raw: Column) -> Column:
    """null for blanks and zeros only."""
    t = F.trim(raw)
    return F.when(~t.rlike("^0*$"), t)


def mt940_transactions(files: DataFrame) -> DataFrame:
    """:61:/:86: pairs; the sign from C or D, symbols from the narrative, currency from :60F:."""
    parts = all_but_first(F.split("content", r"(?s)(?=:61:)"))
    rows = files.select("path", found(F.col("content"), r":60F:[CD]\d{6}([A-Z]{3})").alias("currency"), F.posexplode(parts).alias("k", "t"))
    line = r"^:61:(\d{6})(?:\d{4})?([CD])([\d,]+)"
    raw = normalize_amount(F.regexp_replace(F.regexp_extract("t", line, 3), ",$", ""))
    amount = F.when(F.regexp_extract("t", line, 2) == "D", -raw).otherwise(raw)
    text = F.trim(F.regexp_replace(F.regexp_extract("t", r"(?s):86:(.*?)(?=:6[0-9]F?:|$)", 1), r"\s+", " "))
    rows = rows.select("path", (F.col("k") + 1).alias("n"), _yymmdd(F.regexp_extract("t", line, 1)).alias("date"), amount.cast(MONEY).alias("amount"), "currency", text.alias("description"))
    sym = lambda s: found(F.col("description"), rf"\b{s}[:\s]*(\d+)")
    return rows.where("amount is not null").withColumns({"type": _kind(F.col("amount")), "account": found(F.col("description"), r"\b((?:\d{1,6}-)?\d{2,10}/\d{4})\b"), "variable_symbol": sym("VS"), "constant_symbol": sym("KS"), "specific_symbol": sym("SS")}).select(TX)


def mt940_balances(files: DataFrame) -> DataFrame:
    def side(tag: str, name: str) -> list[Column]:
        p = rf":{tag}:([CD])(\d{{6}})[A-Z]{{3}}([\d,]+)"
        raw = normalize_amount(F.regexp_extract("content", p, 3))
        return [F.when(F.regexp_extract("content", p, 1) == "D", -raw).otherwise(raw).cast(MONEY).alias(name), _yymmdd(F.regexp_extract("content", p, 2)).alias(f"{name}_date")]

    return files.select("path", found(F.col("content"), r":20:([^\n\r]+)").alias("statement_id"), found(F.col("content"), r":25:([^\n\r]+)").alias("account"), *side("60F", "opening"), *side("62F", "closing"))


CAMT = "STRUCT<BkToCstmrStmt: STRUCT<Stmt: STRUCT<Id: STRING, Acct: STRUCT<Id: STRUCT<IBAN: STRING>, Ccy: STRING>, Bal: ARRAY<STRUCT<Tp: STRUCT<CdOrPrtry: STRUCT<Cd: STRING>>, Amt: STRING, CdtDbtInd: STRING, Dt: STRUCT<Dt: STRING>>>, Ntry: ARRAY<STRUCT<Amt: STRUCT<_Ccy: STRING, _VALUE: STRING>, CdtDbtInd: STRING, BookgDt: STRUCT<Dt: STRING>, AddtlNtryInf: STRING>>>>>"


def camt_transactions(files: DataFrame) -> DataFrame:
    bare = F.regexp_replace("content", r'^\s*<\?xml[^>]*\?>\s*|\sxmlns="[^"]*"', "")
    parsed = files.select("path", F.from_xml(bare, CAMT, {"mode": "PERMISSIVE"}).alias("x"))
    rows = parsed.select("path", F.posexplode("x.BkToCstmrStmt.Stmt.Ntry").alias("k", "e"))
    raw = F.col("e.Amt._VALUE").try_cast(MONEY)
    amount = F.when(F.col("e.CdtDbtInd") == "DBIT", -raw).otherwise(raw).cast(MONEY)
    text = F.col("e.AddtlNtryInf")
    sym = lambda s: found(text, rf"\b{s}[:\s]*(\d+)")
    return rows.select("path", (F.col("k") + 1).alias("n"), F.try_to_date(F.col("e.BookgDt.Dt"), "yyyy-MM-dd").alias("date"), amount.alias("amount"), _kind(amount).alias("type"), F.col("e.Amt._Ccy").alias("currency"), F.lit(None).cast("string").alias("account"), sym("VS").alias("variable_symbol"), sym("KS").alias("constant_symbol"), sym("SS").alias("specific_symbol"), text.alias("description"))


def camt_balances(files: DataFrame) -> DataFrame:
    """(path, statement_id, iban, bank_code, account, currency, opening, opening_date, closing, closing_date) of CAMT.053 files.

    The bank's code and the account are read from Czech IBANs.
    """
    bare = F.regexp_replace("content", r'^\s*<\?xml[^>]*\?>\s*|\sxmlns="[^"]*"', "")
    s = files.select("path", F.from_xml(bare, CAMT, {"mode": "PERMISSIVE"}).alias("x")).select("path", "x.BkToCstmrStmt.Stmt.*")

    def side(code: str, name: str) -> list[Column]:
        b = F.get(F.filter("Bal", lambda b: b["Tp"]["CdOrPrtry"]["Cd"] == code), F.lit(0))
        raw = b["Amt"].try_cast(MONEY)
        return [F.when(b["CdtDbtInd"] == "DBIT", -raw).otherwise(raw).cast(MONEY).alias(name), F.try_to_date(F.substring(b["Dt"]["Dt"], 1, 10), "yyyy-MM-dd").alias(f"{name}_date")]

    iban = F.col("Acct.Id.IBAN")
    czech = iban.startswith("CZ")
    return s.select("path", F.col("Id").alias("statement_id"), iban.alias("iban"), F.when(czech, F.substring(iban, 5, 4)).alias("bank_code"), F.when(czech, F.substring(iban, 9, 100)).alias("account"), F.col("Acct.Ccy").alias("currency"), *side("OPBD", "opening"), *side("CLBD", "closing"))


def with_balances(totals: DataFrame, balances: DataFrame) -> DataFrame:
    """totals (path, net_change, ...) with opening and closing; a closing balance that isn't stated is the opening one and the change."""
    out = totals.join(balances.select("path", "opening", "closing"), "path", "left")
    return out.withColumn("closing", F.coalesce("closing", (F.col("opening") + F.col("net_change")).cast(MONEY)))


def abo_transactions(files: DataFrame) -> DataFrame:
    """075 records of fixed width; amounts in hundredths, 1 at place 61 for debit."""
    lines = F.filter(F.split("content", r"\r?\n"), lambda x: x.startswith("075"))
    rows = files.select("path", F.posexplode(lines).alias("k", "l"))
    cut = lambda at, n: F.substring("l", at, n)
    raw = (F.trim(cut(49, 12)).try_cast("decimal(16,0)") / 100).cast(MONEY)
    amount = F.when(cut(61, 1) == "1", -raw).otherwise(raw).cast(MONEY)
    return rows.select("path", (F.col("k") + 1).alias("n"), _yymmdd(cut(86, 6)).alias("date"), amount.alias("amount"), _kind(amount).alias("type"), F.lit("CZK").alias("currency"), F.concat(F.regexp_replace(F.trim(cut(4, 16)), "^0+", ""), F.lit("/"), cut(20, 4)).alias("account"), _symbol(cut(62, 10)).alias("variable_symbol"), _symbol(cut(72, 4)).alias("constant_symbol"), _symbol(cut(76, 10)).alias("specific_symbol"), F.lit(None).cast("string").alias("description"))


#: Column names of statement CSVs by field; fixed values.
CSV_NAMES = {"date": ["datum", "date", "datum zaúčtování", "buchungstag"], "amount": ["částka", "amount", "betrag", "castka"], "currency": ["měna", "currency"], "description": ["popis", "description", "verwendungszweck", "název"], "variable_symbol": ["vs"], "constant_symbol": ["ks"], "specific_symbol": ["ss"]}


def csv_transactions(files: DataFrame) -> DataFrame:
    """Rows of CSV statements by the header's names in any of the languages; delimiter by the header."""
    lines = F.filter(F.split(F.regexp_replace("content", "^\ufeff", ""), r"\r?\n"), lambda x: F.trim(x) != "")
    sep = F.when(F.get("lines", F.lit(0)).contains(";"), ";").otherwise(",")
    found = files.select("path", lines.alias("lines")).withColumn("sep", sep)
    found = found.withColumn("heads", cells(F.lower(F.get("lines", F.lit(0))), F.col("sep")))
    rows = found.select("path", "sep", "heads", F.posexplode(all_but_first(F.col("lines"))).alias("k", "l"))
    rows = rows.withColumn("cells", cells(F.col("l"), F.col("sep")))

    def cell(field: str) -> Column:
        at = F.coalesce(*[F.nullif(F.array_position("heads", F.lit(n)), F.lit(0)) for n in CSV_NAMES[field]])
        return F.nullif(F.get("cells", (at - 1).cast("int")), F.lit(""))

    amount = normalize_amount(cell("amount"))
    return rows.select("path", (F.col("k") + 1).alias("n"), normalize_date(cell("date")).alias("date"), amount.alias("amount"), _kind(amount).alias("type"), F.coalesce(cell("currency"), F.lit("CZK")).alias("currency"), F.lit(None).cast("string").alias("account"), *[cell(c).alias(c) for c in ("variable_symbol", "constant_symbol", "specific_symbol", "description")])


FINSTA = "STRUCT<FINSTA03: STRUCT<S28_CISLO_VYPISU: STRING, SHORTNAME: STRING, FINSTA05: ARRAY<STRUCT<S61_DATUM: STRING, S61_CASTKA: STRING, S61_CD_INDIK: STRING, PART_ACCNO: STRING, PART_BANK_ID: STRING, S86_VARSYMOUR: STRING, S86_KONSTSYM: STRING, S86_SPECSYMOUR: STRING, PART_ID1_1: STRING>>>>"


def finsta_transactions(files: DataFrame) -> DataFrame:
    parsed = files.select("path", F.from_xml(F.regexp_replace("content", r"^\s*<\?xml[^>]*\?>\s*", ""), FINSTA).alias("x"))
    rows = parsed.select("path", F.posexplode("x.FINSTA03.FINSTA05").alias("k", "e"))
    raw = normalize_amount(F.col("e.S61_CASTKA"))
    amount = F.when(F.col("e.S61_CD_INDIK") == "D", -raw).otherwise(raw).cast(MONEY)
    return rows.select("path", (F.col("k") + 1).alias("n"), normalize_date(F.col("e.S61_DATUM")).alias("date"), amount.alias("amount"), _kind(amount).alias("type"), F.lit("CZK").alias("currency"), F.concat("e.PART_ACCNO", F.lit("/"), "e.PART_BANK_ID").alias("account"), _symbol(F.col("e.S86_VARSYMOUR")).alias("variable_symbol"), _symbol(F.col("e.S86_KONSTSYM")).alias("constant_symbol"), _symbol(F.col("e.S86_SPECSYMOUR")).alias("specific_symbol"), F.col("e.PART_ID1_1").alias("description"))


READERS = {"MT940": mt940_transactions, "CAMT053": camt_transactions, "ABO": abo_transactions, "CSV": csv_transactions, "FINSTA": finsta_transactions}


def read_transactions(files: DataFrame) -> DataFrame:
    """Transactions of files of all formats; each reader gets the files of its own."""
    kinds = once(files.withColumn("format", detect_format(F.col("content"))), "format")  # each reader opens its own folder
    parts = [f(kinds.where(F.col("format") == k)).select(*TX).withColumn("format", F.lit(k)) for k, f in READERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_bank_name(tx: DataFrame, code: Column, banks: dict[str, str] = BANKS) -> DataFrame:
    return tx.withColumn("bank_name", F.element_at(F.create_map(*[F.lit(x) for kv in banks.items() for x in kv]), code))


def statement_totals(tx: DataFrame) -> DataFrame:
    """(path, n, net_change, debits, credits, date_from, date_to); net_change closes files that state no balance."""
    return tx.groupBy("path").agg(F.count("*").alias("n"), F.sum("amount").alias("net_change"), F.coalesce(F.sum(F.when(F.col("amount") < 0, -F.col("amount"))), F.lit(0)).cast("decimal(28,2)").alias("debits"), F.coalesce(F.sum(F.when(F.col("amount") >= 0, F.col("amount"))), F.lit(0)).cast("decimal(28,2)").alias("credits"), F.min("date").alias("date_from"), F.max("date").alias("date_to"))


def statement_record(totals: DataFrame, bank: str) -> DataFrame:
    """Archive record of statements: title, tags and correspondent."""
    title = F.concat_ws(" ", F.lit("Statement"), F.lit(bank), F.date_format("date_from", "yyyy-MM-dd"), F.lit("-"), F.date_format("date_to", "yyyy-MM-dd"))
    return totals.select("path", F.substring(title, 1, 128).alias("title"), F.array(F.lit("bank"), F.lit("statement"), F.concat(F.lit("Rok_"), F.year("date_to").cast("string"))).alias("tags"), F.lit(bank).alias("correspondent"), "n", "net_change")
