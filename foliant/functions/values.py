"""Amounts, dates and pattern lookups in text as native column expressions.

Patterns carry (?iu), since the JVM folds case beyond ASCII only then; ``found`` turns the empty
string of a missed match into null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: An amount with two decimals: digits in groups of three, or run together.
AMOUNT = r"\d{1,3}(?:[  .]\d{3})+,\d{2}|\d{1,3}(?:,\d{3})+\.\d{2}|\d+[.,]\d{2}"
DATE = r"\d{1,2}\s?[./-]\s?\d{1,2}\s?[./-]\s?\d{2,4}"
#: Czech month names in the genitive, as they stand in dates; fixed values.
MONTHS = ["ledna", "února", "března", "dubna", "května", "června", "července", "srpna", "září", "října", "listopadu", "prosince"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, "(?iu)" + pattern, group), F.lit(""))


def first_found(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[found(text, p) for p in patterns])


def all_found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit("(?iu)" + pattern), F.lit(group))


def last_line(text: Column) -> Column:
    """What follows the last line feed, or all; a pattern anchored at the end tries each place of each line before it."""
    return F.substring_index(text, "\n", -1)


def cells(line: Column, sep: Column) -> Column:
    """Cells of a line of a CSV file; separators within quotes divide nothing, doubled quotes stand for one."""
    outside = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    parts = F.when(sep == "\t", F.split(line, "\t" + outside, -1)).when(sep == ";", F.split(line, ";" + outside, -1)).otherwise(F.split(line, "," + outside, -1))
    return F.transform(parts, lambda x: F.trim(F.replace(F.regexp_replace(F.trim(x), r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))))


def all_but_first(items: Column) -> Column:
    return F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))


def normalize_amount(raw: Column) -> Column:
    """Decimal of 1 234,56, 1.234,56 or 1,234.56: the later of comma and stop is the decimal sign; else null."""
    return let(F.regexp_replace(raw, r"[\s\u00a0]+", ""), _amount)


def _amount(bare: Column) -> Column:
    comma, stop = F.length(bare) - F.locate(",", F.reverse(bare)), F.length(bare) - F.locate(".", F.reverse(bare))
    has_comma, has_stop = bare.contains(","), bare.contains(".")
    plain = (
        F.when(has_comma & has_stop & (comma > stop), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(has_comma & has_stop, F.replace(bare, F.lit(","), F.lit("")))
        .when(has_comma, F.replace(bare, F.lit(","), F.lit(".")))
        .otherwise(bare)
    )
    return let(plain, lambda p: F.when(p.rlike(r"^[+-]?\d+(\.\d+)?$"), p.try_cast(MONEY)))


def _date(day: Column, month: Column, year: Column) -> Column:
    full = F.when(F.length(year) == 2, F.concat(F.when(year.cast("int") < 50, "20").otherwise("19"), year)).otherwise(year)
    return F.try_to_date(F.concat_ws("-", full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def normalize_date(raw: Column) -> Column:
    """Date of d.m.yyyy (also / and -, two-digit years with pivot 50), ISO, or a Czech month name; else null."""
    return let(raw, _any_date)


def _any_date(raw: Column) -> Column:
    part = lambda p, g: F.nullif(F.regexp_extract(raw, p, g), F.lit(""))
    iso = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
    dmy = r"\b(\d{1,2})\s?[./-]\s?(\d{1,2})\s?[./-]\s?(\d{4}|\d{2})\b"
    named = r"(?iu)\b(\d{1,2})\.?\s+(" + "|".join(MONTHS) + r")\s+(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(raw, named, 2))).cast("string")
    return F.when(raw.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(raw, "d.M.yyyy")).otherwise(F.coalesce(
        F.when(raw.rlike(iso), _date(part(iso, 3), part(iso, 2), part(iso, 1))),
        F.when(raw.rlike(dmy), _date(part(dmy, 1), part(dmy, 2), part(dmy, 3))),
        F.when(raw.rlike(named), _date(part(named, 1), month, part(named, 3))),
    ))
