"""Tests of rows: a grammar of conditions, what a document's file, type and text say of how it is processed, and which documents a question names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import entity_name, indel_ratio
from ledgerloom.functions.scoring import is_tabular

# File extensions and document types that a graph is not made of, other names of such types, and the types whose rows are tables.
SKIPPED_EXTENSIONS = (".xlsx", ".xls", ".xlsm", ".xlsb", ".csv", ".tsv", ".json", ".xml", ".yaml", ".yml", ".log", ".sql")
SKIPPED_TYPES = (
    "invoice", "receipt", "bank_statement", "expense_report", "purchase_order", "quotation", "tax_document", "tax_form",
    "spreadsheet", "excel", "csv", "worksheet", "data_export", "database_export", "data_table",
    "shipping_document", "shipping_manifest", "bill_of_lading", "customs_declaration", "delivery_note", "packing_list",
    "inventory_report", "inventory_list", "stock_report", "price_list", "catalog", "product_list",
    "financial_report", "financial_statement", "balance_sheet", "income_statement", "cash_flow", "cash_flow_statement", "ledger", "journal_entry", "general_ledger",
    "government_form", "application_form", "registration_form", "form",
    "datasheet", "schematic", "log_file", "audit_log",
    "transaction_report", "transaction_history", "payment_history", "order_history",
)
TYPE_ALIASES = {
    "invoice": ("bill", "billing", "billing_document", "vendor_invoice"),
    "receipt": ("meal_receipt", "expense_receipt", "purchase_receipt", "sales_receipt"),
    "bank_statement": ("account_statement", "statement", "bank_account_statement"),
    "spreadsheet": ("workbook", "worksheet", "table_data", "excel_file"),
    "inventory_report": ("inventory", "stock_list", "inventory_list"),
    "financial_report": ("financial", "financials", "financial_statement"),
}
TABULAR_EXTENSIONS = (".csv", ".tsv", ".xlsx", ".xls", ".xlsm", ".xlsb", ".ods")
TABULAR_TYPES = (
    "spreadsheet", "invoice", "receipt", "bank_statement", "credit_card_statement", "expense_report", "inventory_report", "purchase_order", "sales_order", "payroll", "financial_statement",
    "price_list", "data_export", "transaction_log", "shipping_manifest",
)
TABLE_DENSITY, NUMBER_DENSITY = 0.6, 0.4
ROWS_PER_PAGE, OTHER_ROWS = {("invoice", "receipt"): 10, ("bank_statement",): 30, ("inventory_report", "spreadsheet"): 50}, 20
SOURCE_TYPES = {"pdf": (".pdf",), "xlsx": (".xlsx",), "xls": (".xls",), "csv": (".csv",), "image": (".png", ".jpg", ".jpeg", ".tiff", ".bmp")}
# Words that show that a question is about the documents of some name, and the likeness in percent from which names are the same.
TARGETING = (
    "list", "show", "get", "find", "all", "from", "by", "vendor", "supplier", "company", "customer", "client", "invoice", "receipt", "bill", "statement", "order",
)
ALIKE = 80


def condition(column: Column, op: str, *values) -> Column:
    """`column op value`: < > = <= >= !=, `between` with both bounds, `in`, `not_in`, `ilike`, and `compound`, which is above the first value and below the second. A null fails all."""
    tests = {
        "<": lambda: column < values[0], ">": lambda: column > values[0], "=": lambda: column == values[0], "<=": lambda: column <= values[0], ">=": lambda: column >= values[0], "!=": lambda: column != values[0],
        "between": lambda: column.between(*values), "in": lambda: column.isin(*values), "not_in": lambda: ~column.isin(*values), "ilike": lambda: column.ilike(values[0]),
        "compound": lambda: (column > values[0]) & (column < values[1]),
    }
    if op not in tests:
        raise ValueError(f"no condition is named {op}")
    return tests[op]()


def conditions(rows: DataFrame, tests: Sequence[tuple]) -> DataFrame:
    """Rows that pass all of the tests (column, op, values...)."""
    return rows.where(reduce(lambda a, b: a & b, (condition(F.col(c), op, *v) for c, op, *v in tests), F.lit(True)))


def payload(must: Sequence[Column] = (), should: Sequence[Column] = ()) -> Column:
    """All of must, and any of should if there is one; a null test fails."""
    firm = [F.coalesce(t, F.lit(False)) for t in must]
    loose = [F.coalesce(t, F.lit(False)) for t in should]
    test = reduce(lambda a, b: a & b, firm, F.lit(True))
    return test & reduce(lambda a, b: a | b, loose) if loose else test


def extension(filename: Column) -> Column:
    """The file's extension with its dot, in lower case; empty without one."""
    return F.regexp_extract(F.lower(filename), r"[^/.](\.[^./]*)$", 1)


def skip_reason(filename: Column, kind: Column, content: Column, flag: Column, reason: Column) -> Column:
    """Why no graph is made of a document, null if one is: its own flag, else its file's extension, else its type or what that is another name of, else that its text is a table."""
    low = F.lower(F.trim(kind))
    by_type = F.when(low.isin(*SKIPPED_TYPES), low)
    for name, others in TYPE_ALIASES.items():
        by_type = by_type.when(low.isin(*others), name)
    return F.coalesce(
        F.when(flag, F.coalesce(F.nullif(reason, F.lit("")), F.lit("user_disabled:document_flag"))),
        F.when(extension(filename).isin(*SKIPPED_EXTENSIONS), F.concat(F.lit("file_type:"), extension(filename))),
        F.concat(F.lit("document_type:"), by_type), F.concat(F.lit("content_pattern:"), is_tabular(content)),
    )


def table_density(content: Column) -> Column:
    """The share of lines with two bars, or two commas."""
    lines = F.split(content, "\n")
    row = lambda s: (F.regexp_count(s, F.lit(r"\|")) >= 2) | (F.regexp_count(s, F.lit(",")) >= 2)
    return F.coalesce(F.size(F.filter(lines, row)) / F.size(lines), F.lit(0.0))


def number_density(content: Column) -> Column:
    """The share of characters that are digits, dots or commas."""
    return F.coalesce(F.regexp_count(content, F.lit(r"[\d.,]")) / F.greatest(F.length(content), F.lit(1)), F.lit(0.0))


def tabular_reason(filename: Column, kind: Column, content: Column) -> Column:
    """What makes a document one of rows: its extension, else its type, else the density of its tables, else of its numbers; `not_tabular` without any."""
    low = F.lower(F.trim(kind))
    by_type = F.when(low.isin(*TABULAR_TYPES), low)
    for name, others in TYPE_ALIASES.items():
        if name in TABULAR_TYPES:
            by_type = by_type.when(low.isin(*others), name)
    return F.coalesce(
        F.when(extension(filename).isin(*TABULAR_EXTENSIONS), F.concat(F.lit("file_extension:"), extension(filename))), F.concat(F.lit("document_type:"), by_type),
        F.when(table_density(content) > TABLE_DENSITY, "table_density"), F.when(number_density(content) > NUMBER_DENSITY, "numeric_density"), F.lit("not_tabular"),
    )


def path(filename: Column, kind: Column, content: Column) -> Column:
    """How a document is processed: `tabular` or `standard`."""
    return F.when(tabular_reason(filename, kind, content) == "not_tabular", "standard").otherwise("tabular")


def source_type(filename: Column) -> Column:
    """The kind of a document's file, `unknown` for any other."""
    low, found = F.lower(filename), F
    for name, ends in SOURCE_TYPES.items():
        found = found.when(reduce(lambda a, b: a | b, (low.endswith(e) for e in ends)), name)
    return found.otherwise("unknown")


def estimated_rows(known: Column, pages: Column, kinds: Column) -> Column:
    """A document's rows: as it says itself, else so many a page as its types have."""
    low, found = F.transform(F.coalesce(kinds, F.array().cast("array<string>")), F.lower), F
    for names, n in ROWS_PER_PAGE.items():
        found = found.when(F.arrays_overlap(low, F.array(*map(F.lit, names))), n)
    return F.coalesce(known, F.greatest(F.coalesce(pages, F.lit(1)), F.lit(1)) * found.otherwise(OTHER_ROWS))


def eligible(state: Column, kind: Column, extractable: Sequence[str]) -> Column:
    """Whether rows are extracted from a document: it is converted, at least in part, and its type is an extractable one."""
    ready = F.coalesce(state.isin("converted", "partial"), F.lit(True))
    return ready & F.coalesce(F.lower(F.trim(kind)).isin(*extractable), F.lit(False))


def exists(rows: DataFrame) -> DataFrame:
    """(found): whether there is any row; one is read at most."""
    return rows.limit(1).agg((F.count("*") > 0).alias("found"))


def hard(entities: Sequence[str], question: str) -> bool:
    """Whether a question is about the documents of some name alone: the name stands in it, and so does a word that asks for documents."""
    low = question.lower()
    return any(e.lower() in low for e in entities) and any(w in low for w in TARGETING)


def name_match(name: Column, wanted: Sequence[str], alike: float = ALIKE) -> Column:
    """How a name matches one of the wanted ones, tried in order: `exact` as they are or normalized, `substring` either way, `fuzzy`; null if it doesn't, or is empty."""
    forms = [entity_name(F.lit(w)) for w in wanted]
    both = F.array(F.struct(F.lower(name).alias("low"), entity_name(name).alias("own")))  # so that the normal form is made once

    def test(n: Column) -> Column:
        own = n["own"]
        kinds = [F.when((n["low"] == w) | (own == w), "exact").when(own.contains(w) | w.contains(own), "substring").when(indel_ratio(own, w) >= alike, "fuzzy") for w in forms]
        return F.when(F.coalesce(F.length(own), F.lit(0)) > 0, F.coalesce(*kinds))

    return F.get(F.transform(both, test), F.lit(0)) if forms else F.lit(None).cast("string")


def naming(documents: DataFrame, items: DataFrame, wanted: Sequence[str], names: Sequence[str], array: str | None = None, key: str = "document_id", text: str = "description") -> DataFrame:
    """(document_id, match): documents that a name matches in one of their fields or of their array of names, or else in the text of one of their items.

    Items are searched for the documents that have no match alone, and reduced to distinct documents before they are joined.
    """
    tests = [name_match(F.col(c), wanted) for c in names]
    if array:
        tests.append(F.get(F.filter(F.transform(F.col(array), lambda n: name_match(n, wanted)), lambda m: m.isNotNull()), F.lit(0)))
    judged = documents.select(key, F.coalesce(*tests).alias("match"))
    low = F.lower(F.col(text))
    in_items = items.where(reduce(lambda a, b: a | b, (low.contains(entity_name(F.lit(w))) for w in wanted))).select(key).distinct().withColumn("item", F.lit("item"))
    return judged.join(in_items, key, "left").select(key, F.coalesce("match", "item").alias("match")).where("match IS NOT NULL")


def on_topic(documents: DataFrame, items: DataFrame, topics: Sequence[str], kinds: Sequence[str], fields: Sequence[str], key: str = "document_id", kind: str = "schema_type", deleted: str = "deleted_at", text: str = "description") -> DataFrame:
    """Documents that are not deleted, of one of the kinds if any are given, with some topic in one of their fields or in the text of an item; none without topics and kinds."""
    if not topics and not kinds:
        return documents.where("false")
    rows = documents.where(F.col(deleted).isNull())
    if kinds:
        rows = rows.where(F.lower(F.col(kind)).isin(*(k.lower() for k in kinds)))
    if not topics:
        return rows
    holds = lambda c: reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c)).contains(t.lower()), F.lit(False)) for t in topics))
    in_items = items.where(holds(text)).select(key).distinct().withColumn("in_items", F.lit(True))
    test = reduce(lambda a, b: a | b, (holds(c) for c in fields))
    return rows.join(in_items, key, "left").where(test | F.col("in_items").isNotNull()).drop("in_items")
