"""Dates in extracted text, and the ranges that phrases name."""

from __future__ import annotations

import calendar
import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say a text writes the day before the month; the orders in which date fields are tried; names of the months.
DAY_FIRST_WORDS = ("uk", "united kingdom", "london", "manchester", "birmingham", "£", "€", "europe", "paris", "berlin", "madrid")
ROW_DATE_FIELDS = ("invoice_date", "receipt_date", "transaction_date", "date", "statement_date")
ITEM_DATE_FIELDS = ("transaction_date", "invoice_date", "receipt_date", "date", "statement_date")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
UNKNOWN = "Unknown"


def _parsed(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))


def month_key(text: Column) -> Column:
    """yyyy-MM of a date text, read as ISO, y/M/d, M/d/y, then d/M/y; otherwise its first seven characters, or Unknown if it is missing."""
    head = F.substring(text, 1, 10)
    read = F.coalesce(*(_parsed(head, p) for p in ("y-M-d", "y/M/d", "M/d/y", "d/M/y")))
    return F.coalesce(F.date_format(read, "yyyy-MM"), F.when(F.length(text) >= 7, F.substring(text, 1, 7)), F.lit(UNKNOWN))


def quarter_key(text: Column) -> Column:
    """yyyy-Qn; Unknown where the month key names no month."""
    month = F.regexp_extract(month_key(text), r"^(\d{4})-(\d{2})$", 2).try_cast("int")
    return F.when(month.between(1, 12), F.concat(F.substring(month_key(text), 1, 4), F.lit("-Q"), F.ceil(month / 3).cast("string"))).otherwise(UNKNOWN)


def year_key(text: Column) -> Column:
    return F.element_at(F.split(month_key(text), "-"), 1)


def day_first(text: Column) -> Column:
    """Whether a text writes the day first: it names a place that does, or has a slashed date whose first part is over 12."""
    words = F.lower(text).rlike("|".join(re.escape(w) for w in DAY_FIRST_WORDS))
    return F.coalesce(words | text.rlike(r"\b(?:1[3-9]|[2-9]\d)/\d{1,2}/\d{4}\b"), F.lit(False))


def resolve(text: Column, days_first: Column) -> Column:
    """The date of a slashed or dashed text: parts over 12 decide, then the locale; ISO and written-out months are read as they stand; else null."""
    t = F.trim(text)
    first = F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 1).try_cast("int")
    second = F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 2).try_cast("int")
    by_month, by_day = _parsed(t, "M/d/y"), _parsed(t, "d/M/y")
    slashed = F.when(first > 12, by_day).when(second > 12, by_month).when(days_first, by_day).otherwise(by_month)
    others = F.coalesce(*(_parsed(t, p) for p in ("y-M-d", "M-d-y", "MMMM d, y", "MMMM d y", "d MMMM y")))
    return F.to_date(F.when(first.isNotNull(), slashed).otherwise(others))


#: Patterns of date texts with the name of their form, tried in order.
FORMS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}", "MM/DD/YYYY"),
    (r"^\d{4}-\d{2}-\d{2}", "YYYY-MM-DD"),
    (r"^\d{1,2}-\d{1,2}-\d{4}", "MM-DD-YYYY"),
    (r"^\w+ \d{1,2},? \d{4}", "Month DD, YYYY"),
    (r"^\d{1,2} \w+ \d{4}", "DD Month YYYY"),
)


def form(text: Column) -> Column:
    """The name of a date text's form, or Unknown."""
    found = F.lit(None).cast("string")
    for pattern, name in reversed(FORMS):
        found = F.when(F.trim(text).rlike(pattern), name).otherwise(found)
    return F.coalesce(found, F.lit(UNKNOWN))


def clock(text: Column) -> Column:
    """HH:mm:ss of the first time of day in a text, with 12-hour times in 24 hours; null without one."""
    pattern = r"(?i)(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM)?"
    hour = F.regexp_extract(text, pattern, 1).try_cast("int")
    half = F.upper(F.regexp_extract(text, pattern, 4))
    hour = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    second = F.coalesce(F.regexp_extract(text, pattern, 3).try_cast("int"), F.lit(0))
    return F.when(hour.isNotNull(), F.format_string("%02d:%02d:%02d", hour, F.regexp_extract(text, pattern, 2).try_cast("int"), second))


# What date texts look like inside a longer text, in the order in which they are looked for.
ANYWHERE = (
    r"\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?",
    r"\d{4}-\d{2}-\d{2}",
    r"\d{1,2}/\d{1,2}/\d{4}",
    r"\w+\s+\d{1,2},\s+\d{4}",
    r"\w+\s+\d{1,2}\s+\d{4}",
    r"\d{1,2}\s+\w+\s+\d{4}",
)


def find_dates(text: Column) -> Column:
    """Dates in a text, first those of the first pattern, each read under the text's own locale; what is no date is left out, and a date that one pattern has found is not read again by the next."""
    begin = F.struct(text.alias("rest"), day_first(text).alias("days"), F.array().cast("array<date>").alias("found"))

    def step(acc: Column, pattern: Column) -> Column:
        bare = lambda raw: F.regexp_replace(F.regexp_replace(raw, r"\s+\d{1,2}:.*$", ""), r"\s+", " ")
        read = F.transform(F.regexp_extract_all(acc["rest"], pattern, F.lit(0)), lambda raw: F.struct(raw.alias("raw"), resolve(bare(raw), acc["days"]).alias("date")))
        right = F.array(F.filter(read, lambda x: x["date"].isNotNull()))  # so that it is made once
        after = lambda all_: F.struct(
            F.aggregate(all_, acc["rest"], lambda left, x: F.replace(left, x["raw"], F.lit("; "))).alias("rest"), acc["days"].alias("days"), F.concat(acc["found"], F.transform(all_, lambda x: x["date"])).alias("found")
        )
        return F.get(F.transform(right, after), F.lit(0))

    return F.aggregate(F.array(*(F.lit("(?i)" + p) for p in ANYWHERE)), begin, step, lambda acc: acc["found"])


def with_dates(text: Column) -> Column:
    """The text with its distinct dates in ISO form behind it."""
    found = F.array_distinct(find_dates(text))
    return F.when(F.size(found) > 0, F.concat(text, F.lit("\nDates: "), F.array_join(found.cast("array<string>"), ", "))).otherwise(text)


def primary_date(text: Column) -> Column:
    """(date, year, month, day) of the first date in a text."""
    first = F.get(find_dates(text), F.lit(0))
    return F.struct(first.alias("date"), F.year(first).alias("year"), F.month(first).alias("month"), F.dayofmonth(first).alias("day"))


def expand_months(phrase: str) -> str:
    """Month names with a year, each followed by its ISO month: `October 2025` becomes `October 2025 (2025-10)`."""

    def with_iso(m: re.Match) -> str:
        name, year = (m[1], m[2]) if m[1] else (m[4], m[3])
        hits = [i for i, x in enumerate(MONTHS, 1) if x == name.lower() or x[:3] == name.lower()]
        return f"{m[0]} ({year}-{hits[0]:02d})" if hits else m[0]

    return re.sub(r"\b([A-Za-z]{3,9})\s+(\d{4})\b|\b(\d{4})\s+([A-Za-z]{3,9})\b", with_iso, phrase)


def named_range(phrase: str, today: date) -> tuple[str, str] | None:
    """First and last day of the range that a phrase names, as ISO texts; None if it names none, or only the current year by its number."""
    p = phrase.lower()
    if m := re.search(r"\bq([1-4])\b(?:\s+(?:of\s+)?(\d{4}))?", p):
        year, q = int(m[2] or today.year), int(m[1])
        return f"{year}-{3 * q - 2:02d}-01", f"{year}-{3 * q:02d}-{calendar.monthrange(year, 3 * q)[1]}"
    if m := re.search(r"\blast\s+(\d+)?\s*(day|week|month|year)s?\b", p):
        days = int(m[1] or 1) * {"day": 1, "week": 7, "month": 30, "year": 365}[m[2]]
        return (today - timedelta(days=days)).isoformat(), today.isoformat()
    if "this month" in p:
        return today.replace(day=1).isoformat(), today.isoformat()
    if "this year" in p:
        return f"{today.year}-01-01", today.isoformat()
    year = int(m[0]) if (m := re.search(r"\b(?:19|20)\d{2}\b", p)) else None
    for i, name in enumerate(MONTHS, 1):
        if re.search(rf"\b{name}\b", p):
            y = year or today.year
            return f"{y}-{i:02d}-01", f"{y}-{i:02d}-{calendar.monthrange(y, i)[1]}"
    if year and year != today.year:
        return f"{year}-01-01", f"{year}-12-31"
    return None
