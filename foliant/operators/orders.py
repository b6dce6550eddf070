"""Marketplace order exports and invoices: header languages, locale values, orders of rows, totals, VAT."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.values import all_but_first, cells, let, normalize_amount, normalize_date
from foliant.sources.staging import once

NAME_PATTERN = r"(?i)(?:bestellungen|invoices|orders|objednavky)[_-](?:von|from|od)[_-]|amazon.*(?:invoice|order)"
#: Column names of exports by language and canonical field; fixed values.
COLUMNS = {
    "de": {"Bestellnummer": "order_number", "Bestelldatum": "order_date", "Titel": "title", "ASIN": "asin", "Menge": "quantity", "Artikelpreis": "price", "USt.-Satz": "vat_rate", "Gesamtbetrag": "order_total"},
    "en": {"Order Number": "order_number", "Order Date": "order_date", "Title": "title", "ASIN": "asin", "Quantity": "quantity", "Item Price": "price", "VAT Rate": "vat_rate", "Order Total": "order_total"},
    "cs": {"Číslo objednávky": "order_number", "Datum objednávky": "order_date", "Název": "title", "ASIN": "asin", "Množství": "quantity", "Cena": "price", "Sazba DPH": "vat_rate", "Celkem": "order_total"},
}

#: Further names of sums, by canonical field; fixed values.
SUMS = {
    "subtotal": {"de": ["Zwischensumme"], "en": ["Subtotal"], "cs": ["Mezisoučet"]},
    "shipping": {"de": ["Versandkosten (inkl. USt.)", "Versandkosten"], "en": ["Shipping Costs", "Shipping", "Delivery Costs"], "cs": ["Náklady na dopravu", "Doprava"]},
    "promotion": {"de": ["Aktionen (inkl. USt.)", "Werbeaktion", "Rabatt"], "en": ["Promotion", "Discount", "Promo"], "cs": ["Sleva", "Akce"]},
    "vat": {"de": ["USt"], "en": ["VAT"], "cs": ["DPH"]},
    "order_total": {"de": ["Bestellung - Gesamt (inkl. USt.)", "Summe inkl. USt", "Gesamt inkl. USt"], "en": ["Order Total (incl. VAT)", "Total incl. VAT", "Total (incl. VAT)"], "cs": ["Celkem vč. DPH", "Celková objednávka vč. DPH"]},
}
for _field, _names in SUMS.items():
    for _lang, _heads in _names.items():
        COLUMNS[_lang].update({h: _field for h in _heads})


def is_order_export(name: Column, header: Column) -> Column:
    marks = ["ASIN", "Bestellnummer", "Order Number", "Číslo objednávky"]
    by_header = F.lower(name).endswith(".csv") & header.rlike("|".join(marks))
    return F.coalesce(name.rlike(NAME_PATTERN), F.lit(False)) | F.coalesce(by_header, F.lit(False))


def detect_delimiter(header: Column) -> Column:
    """The most frequent of tab, semicolon and comma; tab and semicolon need more than the others."""
    n = lambda ch: F.length(header) - F.length(F.replace(header, F.lit(ch), F.lit("")))
    return F.when((n("\t") > n(";")) & (n("\t") > n(",")), "\t").when(n(";") > n(","), ";").otherwise(",")


def detect_header_language(heads: Column) -> Column:
    """Language with most header names, earlier ones first of equals; unknown for none."""
    scores = [F.struct(F.size(F.array_intersect(heads, F.array(*[F.lit(c) for c in cols]))).alias("n"), F.lit(-k).alias("ord"), F.lit(lang).alias("lang")) for k, (lang, cols) in enumerate(COLUMNS.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["lang"]).otherwise("unknown")


def read_orders(files: DataFrame) -> DataFrame:
    """(path, row, fields...) of order export files (path, content): cells by canonical name, N/A and - null."""
    lines = F.filter(F.split(F.regexp_replace("content", "^\ufeff", ""), r"\r?\n"), lambda x: F.trim(x) != "")
    found = files.select("path", lines.alias("lines")).withColumn("sep", detect_delimiter(F.get("lines", F.lit(0))))
    found = found.withColumn("heads", cells(F.get("lines", F.lit(0)), F.col("sep")))
    every = {h: c for cols in COLUMNS.values() for h, c in cols.items()}
    named = F.transform("heads", lambda h: F.element_at(F.create_map(*[F.lit(x) for kv in every.items() for x in kv]), h))
    names = list(dict.fromkeys(every.values()))
    places = F.transform(F.array(*[F.lit(c) for c in names]), lambda c: (F.nullif(F.array_position("names", c), F.lit(0)) - 1).cast("int"))
    # Language and places of the fields are a file's, so they are found before its rows are taken apart.
    found = found.select("path", "sep", named.alias("names"), detect_header_language(F.col("heads")).alias("language"), all_but_first(F.col("lines")).alias("lines"))
    found = once(found.select("path", "sep", places.alias("places"), "language", "lines"))
    known = lambda v: F.when(~v.isin("", "N/A", "-", "n/a"), v)
    fields = lambda own: F.when(F.size(own) >= 5, F.transform("places", lambda p: known(F.get(own, p))))
    # A row's cells are found once, within the array; as columns of their own every use would split the line again.
    whole = F.transform("lines", lambda line, k: F.struct((k + 1).alias("row"), let(cells(line, F.col("sep")), fields).alias("fields")))
    rows = found.select("path", "language", F.inline(F.filter(whole, lambda x: x["fields"].isNotNull())))
    return rows.select("path", "row", "language", *[F.get("fields", F.lit(k)).alias(c) for k, c in enumerate(names)])


def locale_values(rows: DataFrame) -> DataFrame:
    """Typed columns: date, decimals, VAT rate in percent (rates under 1 are shares)."""
    rate = normalize_amount(F.regexp_replace("vat_rate", "%", ""))
    return rows.withColumns({"order_date": normalize_date(F.col("order_date")), "quantity": F.coalesce(F.col("quantity").try_cast("int"), F.lit(1)), "price": normalize_amount(F.col("price")), **{c: normalize_amount(F.col(c)) for c in SUMS if c in rows.columns}, "vat_rate": F.when(rate < 1, rate * 100).otherwise(rate).cast("decimal(5,2)")})


def group_orders(rows: DataFrame) -> DataFrame:
    """(order_number, order_date, sums..., items): header values and sums (those of SUMS that rows has) from the first row; items in row order, those without id and title dropped."""
    head = ["order_date", *(c for c in SUMS if c in rows.columns)]
    item = F.struct("path", "row", "asin", "title", "quantity", "price", "vat_rate")
    grouped = rows.where("order_number is not null").groupBy("order_number").agg(F.min_by(F.struct(*head), F.struct("path", "row")).alias("h"), F.sort_array(F.collect_list(F.when(F.coalesce("asin", "title").isNotNull(), item))).alias("items"))
    return grouped.select("order_number", *[f"h.{c}" for c in head], "items")


def row_range(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of each file from start to end, both counted from 1 and included."""
    return rows.where(F.col("row").between(start, end))


def order_totals(orders: DataFrame) -> DataFrame:
    """total: the stated one if over 0, else of the items; net of the items."""
    money = lambda f: F.aggregate("items", F.lit(0).cast("decimal(28,4)"), lambda a, x: (a + f(x)).cast("decimal(28,4)"))
    gross = lambda x: F.coalesce(x["price"] * x["quantity"], F.lit(0))
    own = F.round(money(gross), 2).cast("decimal(18,2)")
    net = F.round(money(lambda x: gross(x) * 100 / (100 + F.coalesce(x["vat_rate"], F.lit(0)))), 2).cast("decimal(18,2)")
    return orders.select("order_number", F.when(F.col("order_total") > 0, F.col("order_total")).otherwise(own).alias("total"), net.alias("net"), F.size("items").alias("n_items"))


def order_summary(orders: DataFrame) -> DataFrame:
    """(order_number, net, vat, gross, shipping, promotion) of orders with their items and any of subtotal, vat, order_total, shipping, promotion.

    A stated sum over 0 counts, else that of the items; shipping and promotion (negative where it lowers
    the price) come on top of net, and of gross where that is the items'. Missing columns and nulls are 0.
    """
    stated = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,2)") if c in orders.columns else F.lit(0).cast("decimal(18,2)")
    money = lambda f: F.aggregate("items", F.lit(0).cast("decimal(28,4)"), lambda a, x: (a + f(x)).cast("decimal(28,4)"))
    price = lambda x: F.coalesce(x["price"] * x["quantity"], F.lit(0))
    gross = F.round(money(price), 2).cast("decimal(18,2)")
    net = F.round(money(lambda x: price(x) * 100 / (100 + F.coalesce(x["vat_rate"], F.lit(0)))), 2).cast("decimal(18,2)")
    found = orders.select("order_number", gross.alias("own_gross"), net.alias("own_net"), *[stated(c).alias(f"s_{c}") for c in ("subtotal", "vat", "order_total")], *[stated(c).alias(c) for c in ("shipping", "promotion")])
    or_own = lambda c, own: F.when(F.col(c) > 0, F.col(c)).otherwise(own)
    extra = F.col("shipping") + F.col("promotion")
    sums = {"net": or_own("s_subtotal", F.col("own_net")) + extra, "vat": or_own("s_vat", F.col("own_gross") - F.col("own_net")), "gross": or_own("s_order_total", F.col("own_gross") + extra)}
    return found.select("order_number", *[v.cast("decimal(18,2)").alias(k) for k, v in sums.items()], "shipping", "promotion")


def line_amounts(items: DataFrame) -> DataFrame:
    """net = quantity * price * (1 - discount %), vat = net * rate %, gross; decimals, to cents."""
    cent = F.lit(Decimal("0.01"))
    exact = lambda c: F.col(c).cast("decimal(12,2)")
    net = F.round(exact("quantity") * exact("price") * ((100 - exact("discount")) * cent), 2).cast("decimal(18,2)")
    out = items.withColumn("net", net)
    out = out.withColumn("vat", F.round(F.col("net") * (exact("rate") * cent), 2).cast("decimal(18,2)"))
    return out.withColumn("gross", (F.col("net") + F.col("vat")).cast("decimal(18,2)"))


def document_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(*[F.round(F.sum(c), 2).alias(c) for c in ("net", "vat", "gross")])


def vat_breakdown(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id", "rate").agg(F.round(F.sum("net"), 2).alias("base"), F.round(F.sum("vat"), 2).alias("vat"))


def processing_stats(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count("*").alias("orders"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.sum("n_rows").alias("n_rows"), F.round(F.sum(F.when(F.col("ok"), F.col("amount"))), 2).alias("amount"))


def einvoice_candidates(docs: DataFrame, exported: DataFrame, types: list[str]) -> DataFrame:
    return docs.where(F.col("document_type").isin(types)).join(exported.select("doc_id").distinct(), "doc_id", "left_anti")
