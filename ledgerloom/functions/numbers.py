"""Numbers in extracted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a missing cell, signs of money, currency codes, and words of a column name that say whether it holds money.
NULL_TOKENS = ("null", "none", "n/a", "-")
MONEY_SIGNS = "[$€£¥]"
CURRENCIES = ("USD", "CAD", "EUR", "GBP", "JPY", "CNY", "AUD", "CHF", "INR", "MXN")
NON_MONEY_WORDS = ("quantity", "qty", "stock", "count", "number", "units", "items", "id", "year", "month")
MONEY_WORDS = ("amount", "total", "price", "cost", "revenue", "tax", "fee", "balance", "subtotal", "discount")


def parse_number(text: Column) -> Column:
    """The number a text shows, without thousands separators and signs of money; null if it shows none."""
    return F.regexp_replace(F.trim(text), "[,$€£¥]", "").try_cast("double")


def is_numeric(text: Column) -> Column:
    return F.coalesce(parse_number(text).isNotNull(), F.lit(False))


def parse_cell(text: Column) -> Column:
    """(text, number, whole, monetary) of a table cell: null tokens give nulls; whole is set where the number is written without a point."""
    missing = text.isNull() | (text == "") | F.lower(text).isin(*NULL_TOKENS)
    number = F.when(~missing, parse_number(text))
    whole = F.when(number.isNotNull() & ~text.contains(".") & (number == F.floor(number)), number.cast("long"))
    monetary = F.coalesce(~missing & text.rlike(MONEY_SIGNS), F.lit(False))
    return F.struct(F.when(~missing, text).alias("text"), number.alias("number"), whole.alias("whole"), monetary.alias("monetary"))


def currency_code(code: Column) -> Column:
    """The code in capitals if it is a known one, else null."""
    return F.when(F.upper(code).isin(*CURRENCIES), F.upper(code))


def holds_money(column: str) -> bool:
    """Whether a column's name says that it holds money: words against it come first, and without either kind it does."""
    name = column.lower()
    if any(w in name for w in NON_MONEY_WORDS):
        return False
    return True


def format_cell(value: Column, column: str) -> Column:
    """A number as a report shows it: a dash for null, percent, money with two places, or a whole number."""
    name = column.lower()
    if "percent" in name or "rate" in name:
        shown = F.concat(F.format_number(value, 1), F.lit("%"))
    elif holds_money(column):
        shown = F.concat(F.lit("$"), F.format_number(value, 2))
    else:
        shown = F.format_number(value, 0)
    return F.coalesce(shown, F.lit("-"))
