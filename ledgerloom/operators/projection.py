"""Rows of extracted records as named fields: by a mapping of meanings, by lists of names, or from the record itself where it has no items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import parse_number

# Names of fields in the order in which they are tried, and what each meaning of a column is called in a row.
ROW_DATES = ("invoice_date", "receipt_date", "transaction_date", "date", "statement_date")
INHERITED_DATES = ("transaction_date", "invoice_date", "receipt_date", "date", "statement_date")
ROW_AMOUNTS = ("total_amount", "total", "amount", "grand_total")
ROW_ENTITIES = ("vendor_name", "merchant_name", "customer_name", "company_name")
OUTPUT = {
    "date": "date", "amount": "amount", "quantity": "quantity", "category": "category", "entity": "entity_name", "product": "product", "status": "status", "region": "region", "method": "payment_method", "person": "sales_rep",
}
ITEM_FIELDS = {
    "date": ("Purchase Date", "purchase_date", "Date", "date", "Order Date", "order_date", "Transaction Date", "transaction_date", "Invoice Date", "invoice_date"),
    "amount": ("Total Sales", "total_sales", "Total", "total", "Amount", "amount", "Total Amount", "total_amount", "Grand Total", "grand_total", "Price", "price"),
    "category": ("Category", "category", "Type", "type", "Product Category", "product_category"),
    "entity_name": ("Customer Name", "customer_name", "Vendor", "vendor", "Customer", "customer", "Sales Rep", "sales_rep", "Merchant", "merchant"),
    "product": ("Product", "product", "Item", "item", "Description", "description", "Product Name", "product_name"),
    "quantity": ("Quantity", "quantity", "Qty", "qty", "Count", "count"),
    "status": ("Status", "status", "Order Status", "order_status"),
    "region": ("Region", "region", "Area", "area", "Location", "location"),
}
NUMBERS = ("amount", "quantity")


def _field(data: Column, name: str) -> Column:
    """The text of a field of a map; null for an empty one."""
    return F.nullif(F.try_element_at(data, F.lit(name)), F.lit(""))


def _first_of(data: Column, names: Sequence[str]) -> Column:
    """What a map has by the first of the named fields that are in it. The map's own few names decide which one that is, so it is looked up once, not once for each name."""
    return F.try_element_at(data, F.get(F.array_intersect(F.array(*map(F.lit, names)), F.map_keys(data)), F.lit(0)))


def first_field(data: Column, names: Sequence[str]) -> Column:
    """The first of the named fields of a map that is neither missing nor empty."""
    return F.coalesce(*(_field(data, n) for n in names))


def record_row(header: Column, summary: Column) -> list[Column]:
    """date, amount and entity_name of a record: for the amount each name is looked up in the header, then in the summary; one that is there ends the search, even if it holds no number."""
    amounts = [F.try_element_at(part, F.lit(n)) for n in ROW_AMOUNTS for part in (header, summary)]
    return [first_field(header, ROW_DATES).alias("date"), parse_number(F.coalesce(*amounts)).alias("amount"), first_field(header, ROW_ENTITIES).alias("entity_name")]


def mapped_row(item: Column, header: Column, mappings: Mapping[str, tuple[str, str]]) -> list[Column]:
    """A column for each meaning in mappings, {column: (meaning, kind)}: of several columns of one meaning the last that the item has. A missing date is the record's."""
    found: dict[str, Column] = {}
    for name, (meaning, kind) in mappings.items():
        output = OUTPUT.get(meaning)
        if output is None:
            continue
        raw = F.try_element_at(item, F.lit(name))
        value = parse_number(raw) if kind == "number" else F.nullif(raw, F.lit(""))
        before = found.get(output)
        found[output] = value if before is None else F.when(raw.isNotNull(), value).otherwise(before)
    found["date"] = F.coalesce(found.get("date", F.lit(None).cast("string")), first_field(header, INHERITED_DATES))
    return [c.alias(n) for n, c in found.items()]


def listed_row(item: Column, header: Column) -> list[Column]:
    """The fields of an item that has no mappings, by the names that they usually go by; a missing date is the record's, by the same names."""
    there = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    full = lambda m: F.map_filter(m, lambda _, v: v != "")
    out = []
    for name, fields in ITEM_FIELDS.items():
        if name in NUMBERS:
            value = parse_number(_first_of(there(item), fields))
        else:
            value = _first_of(full(item), fields)
        out.append((F.coalesce(value, _first_of(full(header), fields)) if name == "date" else value).alias(name))
    return out


def record_rows(records: DataFrame, items: DataFrame, key: str = "document_id") -> DataFrame:
    """A row for each item of a record, with its number and data, and one with neither for a record without items."""
    return records.join(items, key, "left")


def field_value(header: Column, summary: Column, item: Column, name: str, source: str) -> Column:
    """The text of a field where it lives: in the header, the summary or the item."""
    return F.try_element_at({"header": header, "summary": summary, "item": item}[source], F.lit(name))


def number_of(header: Column, summary: Column, name: str) -> Column:
    """The field as a number, from the header, else the summary, else 0; null if it is none."""
    return F.coalesce(F.try_element_at(header, F.lit(name)), F.try_element_at(summary, F.lit(name)), F.lit("0")).try_cast("double")


def ordered(columns: Sequence[tuple[str, str]]) -> list[str]:
    """Names of (name, source): the header's, the summary's, the item's; in each, descriptions before amounts, and else as they come."""
    rank = {"header": 0, "summary": 1, "item": 2}
    money = ("amount", "total", "price", "cost")
    place = lambda c: (rank.get(c[1], 3), 0 if "description" in c[0].lower() else 2 if any(m in c[0].lower() for m in money) else 1)
    return [name for name, _ in sorted(columns, key=place)]


def with_currency(rows: DataFrame, items: DataFrame, keys: Sequence[str] = ("document_id", "line_number")) -> DataFrame:
    """rows with is_currency of the item that they come from; null where there is none. Items repeat no key."""
    return rows.join(items.select(*keys, "is_currency"), list(keys), "left")


def grouped_mappings(mappings: Mapping[str, Mapping[str, str]]) -> dict[str, dict[str, Mapping[str, str]]]:
    """{column: {source, ...}} as {source: {column: ...}}; a column without a source is an item's."""
    out: dict[str, dict[str, Mapping[str, str]]] = {"header": {}, "summary": {}, "item": {}}
    for name, mapping in mappings.items():
        out.setdefault(mapping.get("source", "item"), {})[name] = {k: v for k, v in mapping.items() if k != "source"}
    return out


def serialized(rows: DataFrame) -> DataFrame:
    """rows with decimals as doubles, and dates and times as ISO texts."""
    kinds = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd'T'HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd'T'HH:mm:ss"}
    one = lambda c, t: F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.date_format(c, kinds[t]).alias(c) if t in kinds else F.col(c)
    return rows.select(*(one(c, t) for c, t in rows.dtypes))


def schema_groups(documents: DataFrame, most: int = 10, kind: str = "schema_type", fields: str = "fields", key: str = "document_id") -> DataFrame:
    """(schema_type, documents, common_fields, can_combine) of each type, `unknown` for none: the fields that all its documents have, `most` of them at most by name, and whether there is any.

    Fields are counted by document, so that a type's documents never meet in one row.
    """
    rows = documents.select(F.coalesce(kind, F.lit("unknown")).alias(kind), key, fields)
    counts = rows.groupBy(kind).agg(F.count("*").alias("documents"))
    names = rows.select(kind, F.explode(F.array_distinct(fields)).alias("field")).groupBy(kind, "field").agg(F.count("*").alias("n"))
    common = names.join(counts, kind).where("n = documents").groupBy(kind).agg(F.slice(F.sort_array(F.collect_list("field")), 1, most).alias("common_fields"))
    found = F.coalesce("common_fields", F.array().cast("array<string>"))
    return counts.join(common, kind, "left").select(kind, "documents", found.alias("common_fields"), ((F.col("documents") > 1) & (F.size(found) > 0)).alias("can_combine"))


def distinct_items(items: DataFrame, key: str, number: str, data: str) -> DataFrame:
    """Items of a document without those whose data an earlier one has, whatever the order of its fields. Items are dealt by document; if they are already, nothing is shuffled."""
    rows = items.withColumn("_sorted", F.array_sort(F.map_entries(data)))
    first = F.min(number).over(Window.partitionBy(key, "_sorted"))
    return rows.withColumn("_first", first).where(F.col(number) == F.col("_first")).select(items.columns)


def without_repeats(rows: DataFrame, page: str, at: str, category: str, text: str, box: str, most: int = 5) -> DataFrame:
    """Rows of a page without what a model repeats: of a category and text seen `most` times or more, and of a box seen twice or more, the first stays.

    Groups are reduced to their number and first place and joined back, so none is gathered.
    """
    pairs = rows.groupBy(page, category, text).agg(F.count("*").alias("pairs"), F.min(at).alias("first_pair"))
    boxes = rows.groupBy(page, box).agg(F.count("*").alias("boxes"), F.min(at).alias("first_box"))
    same = lambda a, b, cols: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in cols))
    p = rows.alias("r").join(pairs.alias("p"), same(rows, pairs, [page, category, text])).select("r.*", "pairs", "first_pair")
    b = p.join(boxes.withColumnRenamed(page, "b_page").withColumnRenamed(box, "b_box"), p[page].eqNullSafe(F.col("b_page")) & p[box].eqNullSafe(F.col("b_box")))
    kept = ((F.col("pairs") < most) | (F.col(at) == F.col("first_pair"))) & ((F.col("boxes") < 2) | (F.col(at) == F.col("first_box")))
    return b.where(kept).select(rows.columns)


def repaired(owners: DataFrame, children: DataFrame, key: str, counter: str) -> DataFrame:
    """owners with their counter set to the number of children, 0 without any."""
    counts = children.groupBy(key).agg(F.count("*").alias("counted"))
    kind = dict(owners.dtypes)[counter]
    rest = [c for c in owners.columns if c != counter]
    return owners.join(counts, key, "left").select(*rest, F.coalesce("counted", F.lit(0)).cast(kind).alias(counter))


def next_place(rows: DataFrame, by: str, order: str) -> DataFrame:
    """(by, place): the place after the last one."""
    return rows.groupBy(by).agg((F.coalesce(F.max(order), F.lit(0)) + 1).alias("place"))


def regions(pages: DataFrame, document: str, page: str, n: int = 1) -> DataFrame:
    """The first, middle and last n pages of each document, each once. pages are numbered from 1 without gaps; only their number is joined back."""
    last = pages.groupBy(document).agg(F.max(page).alias("pages"))
    total, at = F.col("pages"), F.col(page)
    middle = F.floor(total / 2) - F.floor(F.lit(n) / 2) + 1
    part = F.when(at <= n, "first").when(at > total - n, "last").when((at >= middle) & (at < middle + n), "middle")
    return pages.join(last, document).withColumn("region", part).where("region IS NOT NULL").drop("pages")
