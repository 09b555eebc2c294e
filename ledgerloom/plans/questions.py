"""Questions in words compiled to plans: which groupings, in which order, of which amount, or all details, or a count."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans.phrases import report_kind

# Words that ask for a grouping by time, in the order in which they are tried, and words that stand for a meaning.
TIME_WORDS = (
    ("year", ("by year", "yearly", "per year", "each year", "and year")), ("month", ("by month", "monthly", "per month", "each month", "and month")), ("quarter", ("by quarter", "quarterly", "per quarter")),
)
MEANING_WORDS = {
    "category": ("category", "categories", "categorie"), "status": ("status", "statuses"), "region": ("region", "regions"), "product": ("product", "products"),
    "entity": ("entity", "customer", "customers", "customer name", "vendor", "vendors", "client", "clients", "supplier", "suppliers", "entities"),
}
PARTIES = ("customer", "vendor", "client", "supplier")
DOCUMENT_WORDS = ("document", "file", "invoice", "receipt", "record", "order")
#: How far behind `first` a word may stand that it speaks of.
FIRST_REACH = 50
SOURCES = ("header", "summary", "item")


@dataclass(frozen=True)
class Field:
    """A column of the extracted data: its name there, what it means, where it lives, and whether it is summed or grouped by."""

    name: str
    meaning: str
    source: Literal["header", "summary", "item"] = "item"
    use: Literal["sum", "group_by", "none"] = "none"

    @property
    def column(self) -> str:
        return self.name.lower().replace(" ", "_")


@dataclass(frozen=True)
class Statement:
    """What a question asks for. keys are names of `year`, `month` or `quarter`, or fields, in the order in which they group and sort."""

    kind: Literal["summary", "detail", "count"]
    keys: tuple[Field | str, ...] = ()
    date: Field | None = None
    amount: Field | None = None
    fields: tuple[Field, ...] = ()
    level: Literal["document", "item"] = "item"


def granularity(question: str) -> str | None:
    """The time that a question groups by, coarse before fine; None without any."""
    q = question.lower()
    return next((name for name, words in TIME_WORDS if any(w in q for w in words)), None)


def _mentioned(field: Field, question: str) -> bool:
    return any(w in question for w in (*MEANING_WORDS.get(field.meaning, (field.meaning,)), field.name.lower()))


def _fields_first(question: str, groups: Sequence[Field]) -> bool:
    """Whether the question names a field before a time: behind `first`, or in the order of its words."""
    if "first" in question:
        at = question.find("first")
        if any(w in question[at : at + FIRST_REACH] for w in (*(g.name.lower() for g in groups), *PARTIES)):
            return True
    place = lambda words: min((question.find(w) for w in words if w in question), default=len(question))
    return place([*(g.name.lower() for g in groups), *PARTIES[:3]]) < place([name for name, _ in TIME_WORDS])


def compiled(question: str, fields: Sequence[Field], kind: str | None = None) -> Statement:
    """The statement of a question over fields: the first date, the last amount that is summed, and those fields to group by, or parties, that it mentions. Without a kind, the question's words tell it.

    Raises ValueError for two fields that would give one column.
    """
    columns = [f.column for f in fields]
    if len(set(columns)) < len(columns):
        raise ValueError(f"fields give the same column: {sorted(c for c in set(columns) if columns.count(c) > 1)}")
    q, kind = question.lower(), kind or report_kind(question)
    if kind == "count":
        return Statement("count", level="document" if any(w in q for w in DOCUMENT_WORDS) else "item")
    if kind == "detail":
        return Statement("detail", date=next((f for f in fields if f.meaning == "date"), None), fields=tuple(sorted(fields, key=lambda f: SOURCES.index(f.source))))
    date = amount = None
    groups = []
    for f in fields:
        if f.meaning == "date" and date is None:
            date = f
        elif f.meaning == "amount" and f.use == "sum":
            amount = f
        elif f.use == "group_by" or f.meaning == "entity":
            groups.append(f)
    named = [f for f in groups if _mentioned(f, q)]
    time = [t] if date and (t := granularity(q)) else []
    keys = (*named, *time) if named and time and _fields_first(q, groups) else (*time, *named)
    return Statement("summary", keys, date, amount)


def value(rows: DataFrame, f: Field) -> Column:
    """A field where it lives, as text: a member of a struct, or of a map; null where a map hasn't got it."""
    whole = F.col(f.source)
    return (whole.getField(f.name) if isinstance(rows.schema[f.source].dataType, T.StructType) else F.try_element_at(whole, F.lit(f.name))).cast("string")


def time_key(name: str, date: Column) -> Column:
    """The year as a number, the month as 2024-05, the quarter as 2024-Q2; null for what is no date."""
    at = date.try_cast("timestamp")
    return {"year": F.year(at), "month": F.date_format(at, "yyyy-MM"), "quarter": F.concat(F.year(at).cast("string"), F.lit("-Q"), F.quarter(at).cast("string"))}[name]


def planned(statement: Statement, rows: DataFrame, key: str = "document_id", line: str = "line_number") -> DataFrame:
    """The plan of a statement over items, each with the header, summary and item that it needs; rows are those that may be read.

    A summary has its keys, item_count and total_amount, sorted by the keys; missing amounts count as rows and not as money. Details have all fields, the header's first, and row_number, sorted by descending date and the line.
    A count has total_count, of items or of the documents that have some.
    """
    if statement.kind == "count":
        return rows.agg((F.count_distinct(key) if statement.level == "document" else F.count("*")).alias("total_count"))
    if statement.kind == "detail":
        latest = [F.desc_nulls_last("_date")] if statement.date else []
        shown = [value(rows, f).alias(f.column) for f in statement.fields]
        day = [value(rows, statement.date).alias("_date")] if statement.date else []
        return rows.select(*shown, F.col(line).alias("row_number"), *day).orderBy(*latest, "row_number").drop("_date")
    named = [(k, time_key(k, value(rows, statement.date))) if isinstance(k, str) else (k.column, value(rows, k)) for k in statement.keys]
    measures = [F.count("*").alias("item_count")]
    if statement.amount:
        measures.append(F.round(F.sum(value(rows, statement.amount).try_cast("decimal(28,6)")), 2).cast("double").alias("total_amount"))
    if not named:
        return rows.agg(*measures)
    return rows.groupBy(*(c.alias(n) for n, c in named)).agg(*measures).orderBy(*(n for n, _ in named))


def answer(question: str, rows: DataFrame, fields: Sequence[Field], kind: str | None = None) -> DataFrame:
    return planned(compiled(question, fields, kind), rows)
