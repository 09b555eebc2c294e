"""How relevant a document is for a question, by its names, type, fields and values, and how a result is laid out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What raises and lowers a score, words of questions about numbers and about data, and the fields that name a party.
NAMED, TYPED, TABULAR, UNNAMED, MISTYPED = 0.3, 0.25, 0.35, 0.4, 0.5
ANALYTICS = (
    "sum", "total", "count", "average", "avg", "min", "max", "how many", "how much", "calculate", "aggregate", "group by", "report", "analysis", "statistics", "breakdown", "list", "show",
)
DATA = (
    "inventory", "product", "products", "sales", "quantity", "amount", "price", "cost", "revenue", "stock", "order", "orders", "invoice", "invoices", "receipt", "receipts", "meal", "meals",
    "food", "expense", "expenses",
)
AGGREGATIONS = ("sum", "total", "count", "average", "avg", "min", "max", "group")
STOP = ("the", "a", "an", "for", "all", "how", "many", "we", "have", "is", "are", "and", "or", "to", "in", "of", "with", "finally", "please", "can", "you")
BEFORE_NAMES = ("from", "by", "for", "vendor", "supplier", "company", "customer", "client", "merchant", "store", "seller")
NO_NAMES = ("the", "a", "an", "and", "or", "for", "from", "by", "to", "in", "on", "at")
PARTIES = ("vendor_name", "customer_name", "store_name", "company_name", "merchant_name")
TABLES, BILLS, TEXTS = ("tabular", "spreadsheet", "csv", "excel", "table"), ("invoice", "receipt", "bill"), ("document", "text", "pdf")
BILL_WORDS = ("invoice", "receipt", "amount", "total", "price")
TYPE_WORDS = {"receipt": ("receipt", "receipts"), "invoice": ("invoice", "invoices"), "spreadsheet": ("spreadsheet", "excel", "csv", "sheet"), "document": ("document", "documents", "pdf")}
TOPIC_WORDS = ("meal", "food", "grocery", "office", "supplies", "equipment", "travel", "hotel", "flight", "transport", "subscription", "software", "hardware", "service", "utilities")
# What a column's name says about its format, and the meaning that overrides it.
FORMATS = (
    ("currency", "right", ("amount", "total", "price", "cost", "sales", "revenue")), ("date", "center", ("date", "time", "created", "updated")), ("number", "right", ("count", "quantity", "qty", "number")),
    ("percentage", "right", ("rate", "percent", "ratio")),
)
MEANINGS = {"amount": ("currency", "right"), "date": ("date", "center"), "quantity": ("number", "right")}


def hints(question: str) -> tuple[list[str], list[str]]:
    """(topics, types of documents) that a question mentions."""
    q = question.lower()
    return [t for t in TOPIC_WORDS if t in q], [kind for kind, words in TYPE_WORDS.items() if any(w in q for w in words)]


def asked_names(question: str) -> list[str]:
    """Names of parties in a question: the word behind one like `from` or `vendor`, with up to three capitalized ones that follow."""
    words, found = question.split(), []
    for i, word in enumerate(words):
        if i and word.lower() not in NO_NAMES and words[i - 1].lower() in BEFORE_NAMES:
            end = i + 1
            while end < min(i + 4, len(words)) and words[end][0].isupper():
                end += 1
            found.append(" ".join(words[i:end]).strip(".,!?"))
    return found


def name_score(wanted: Sequence[str], names: Column) -> Column:
    """1 if one of the names is a wanted one, 0.8 if one holds the other, for the first wanted name with either; else 0. names is an array of texts, in any case."""
    own = F.transform(F.filter(names, lambda n: n.isNotNull() & (n != "")), lambda n: F.trim(F.lower(n)))
    score = F.lit(0.0)
    for w in reversed([w.lower().strip() for w in wanted]):
        score = F.when(F.array_contains(own, w), 1.0).when(F.exists(own, _either(w)), 0.8).otherwise(score)
    return score


def _either(w: str):
    return lambda n: n.contains(w) | F.lit(w).contains(n)


def relevance(question: str, kind: Column, header: Column, fields: Column, names: Column | None = None, types: Sequence[str] = (), columns: Column | None = None) -> Column:
    """How relevant a document is, from 0 to 1.

    kind is its type, header a map of texts, fields an array of field names, names an array of further names, columns an array of a table's heads. Names, types, fields, heads and numbers that the question speaks of raise the score;
    a document without fields is lowered, one of another type than `types` halved, and one without a name that the question asks for kept to UNNAMED of its score. Missing parts say nothing.
    """
    q = question.lower()
    words = {w for w in q.split() if len(w) > 2 and w not in STOP}
    sums, data = words & set(AGGREGATIONS), words & set(DATA)
    analytics = any(w in q for w in ANALYTICS)
    value = lambda c, test, gain: c + F.when(F.coalesce(test, F.lit(False)), gain).otherwise(0.0)
    none = F.lit(None).cast("array<string>")

    wanted = asked_names(question)
    own = F.concat(F.array(*(F.try_element_at(header, F.lit(f)) for f in PARTIES)), F.coalesce(names if names is not None else none, F.array().cast("array<string>")))
    by_name = F.coalesce(name_score(wanted, own), F.lit(0.0)) if wanted else F.lit(0.0)
    score = by_name * NAMED

    low = F.lower(F.coalesce(kind, F.lit("")))
    hinted = F.lit(False)
    for t in types:
        hinted = hinted | low.contains(t.lower()) | F.lit(t.lower()).contains(low)
    known = F.coalesce(kind != "", F.lit(False))
    hinted = known & hinted
    score = value(score, hinted, TYPED)
    table, bill, text = (known & low.isin(*group) for group in (TABLES, BILLS, TEXTS))
    score = value(score, table, TABULAR) if analytics or sums else value(score, table & ~hinted, 0.2)
    billed = bill & ~hinted & F.lit(bool(data & set(BILL_WORDS)))
    score = value(value(score, billed, TYPED), text & ~hinted, 0.1)
    if types:
        score = score * F.when(known & ~hinted & ~billed, MISTYPED).otherwise(1.0)

    parts = F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda f: F.split(F.trim(F.regexp_replace(F.lower(f), r"[_\-\s]+", " ")), " "))
    holding = lambda some: F.size(F.filter(parts, lambda p: F.arrays_overlap(p, F.array(*map(F.lit, sorted(some)))))) if some else F.lit(0)
    score = score + 0.3 * F.least(holding(data), F.lit(2)) + 0.15 * F.least(holding(words), F.lit(3))
    if columns is not None and data:
        heads = F.lower(F.array_join(F.coalesce(columns, F.array().cast("array<string>")), " "))
        met = sum((F.when(heads.contains(w), 1).otherwise(0) for w in sorted(data)), F.lit(0))
        score = score + 0.2 * F.least(met, F.lit(2))
    if sums:
        number = lambda _, v: F.regexp_replace(v, r"[.\-]", "").rlike(r"^\d+$")
        score = value(score, F.size(F.map_filter(header, number)) > 0, 0.1)
    bare = ~F.coalesce(F.size(fields) > 0, F.lit(False))
    score = F.greatest(score - F.when(bare, 0.2).otherwise(0.0), F.when(bare, 0.1).otherwise(0.0))
    if wanted:
        score = score * F.when(by_name > 0, 1.0).otherwise(UNNAMED)
    return F.least(score, F.lit(1.0))


@dataclass(frozen=True)
class Shown:
    """A column of a report."""

    field: str
    header: str
    format: str
    alignment: str


def layout(columns: Sequence[str], meanings: Mapping[str, str] | None = None) -> list[Shown]:
    """How each column of a result is shown: by the words of its name, or else as text; its meaning comes before both."""
    out = []
    for c in columns:
        kind, side = next(((kind, side) for kind, side, words in FORMATS if any(w in c.lower() for w in words)), ("text", "left"))
        kind, side = MEANINGS.get((meanings or {}).get(c, ""), (kind, side))
        out.append(Shown(c, c.replace("_", " ").title(), kind, side))
    return out


def totals(rows: DataFrame, shown: Sequence[Shown]) -> DataFrame:
    """(records, and the total of each column of money): one row, in one pass; texts that are no numbers count 0."""
    money = [s for s in shown if s.format == "currency"]
    return rows.agg(F.count("*").alias("records"), *(F.round(F.coalesce(F.sum(F.col(s.field).try_cast("decimal(28,6)")), F.lit(0)), 2).cast("double").alias(s.field) for s in money))
