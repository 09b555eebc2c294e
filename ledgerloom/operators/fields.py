"""What the fields of records mean: inferred from names and values, renamed to canonical names, kept in a registry of schemas."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Meaning, type and aggregation of a field by parts of its name; the first that fits counts.
MEANINGS = (
    ("date", "datetime", None, ("date", "time", "created", "updated", "timestamp", "day", "when", "period")),
    ("person", "string", "group_by", ("sales rep", "sales_rep", "representative", "agent", "salesperson", "manager", "assignee", "owner")),
    ("method", "string", "group_by", ("payment method", "payment_method", "pay method", "shipping method", "channel")),
    ("amount", "number", "sum", ("total sales", "total_sales", "total amount", "total_amount", "grand total", "amount", "revenue", "cost", "fee", "tax", "subtotal")),
    ("unit_price", "number", None, ("unit price", "unit_price", "unit cost", "price each", "rate")),
    ("quantity", "number", "sum", ("quantity", "qty", "count", "units", "items", "number of")),
    ("category", "string", "group_by", ("category", "type", "class", "group", "classification", "segment")),
    ("status", "string", "group_by", ("status", "state", "condition", "stage", "phase")),
    ("entity", "string", "group_by", ("customer name", "customer_name", "vendor name", "vendor_name", "supplier", "client", "company", "merchant")),
    ("product", "string", "group_by", ("product", "item", "sku", "goods", "service")),
    ("region", "string", "group_by", ("region", "area", "location", "zone", "territory", "country", "city", "state")),
    ("identifier", "string", None, ("order id", "order_id", "id", "number", "code", "reference", "invoice", "receipt")),
)
#: Fields with fewer distinct values than this share of their values are categories.
FEW = 0.5


def values(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(field, value): the columns of a frame as rows of texts; numbers, dates and the rest as Spark writes them."""
    names = rows.columns if columns is None else columns
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in names))
    return rows.select(F.inline(pairs))


def by_name(name: Column) -> Column:
    """Meaning, type and aggregation that a field's name tells; null where it tells none."""
    plain = F.regexp_replace(F.lower(name), "[_-]", " ")
    found = F.lit(None).cast("struct<semantic_type:string,data_type:string,aggregation:string>")
    for meaning, kind, aggregation, parts in reversed(MEANINGS):
        told = F.struct(F.lit(meaning).alias("semantic_type"), F.lit(kind).alias("data_type"), F.lit(aggregation).cast("string").alias("aggregation"))
        found = F.when(reduce(lambda a, b: a | b, (plain.contains(p) for p in parts)), told).otherwise(found)
    return found


def inferred(pairs: DataFrame) -> DataFrame:
    """(field, semantic_type, data_type, aggregation) of every field of (field, value) rows, from its name, else from all its values.

    Values are counted by field and value first, so a field that most rows have is spread over its values before it is folded. Fields without a value are unknown texts.
    """
    counts = pairs.groupBy("field", "value").agg(F.count("value").alias("n"))
    number, day = F.col("value").try_cast("double").isNotNull(), F.col("value").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    present = counts.where("value IS NOT NULL").groupBy("field").agg(F.every(number).alias("numbers"), F.every(day).alias("days"), F.count("value").alias("distinct"), F.sum("n").alias("n"))
    fields = counts.select("field").distinct().join(present, "field", "left")
    told = by_name(F.col("field"))
    as_struct = lambda m, k, a: F.struct(F.lit(m).alias("semantic_type"), F.lit(k).alias("data_type"), F.lit(a).cast("string").alias("aggregation"))
    by_value = (
        F.when(F.col("numbers"), as_struct("quantity", "number", "sum")).when(F.col("days"), as_struct("date", "datetime", None))
        .when(F.col("distinct") < FEW * F.col("n"), as_struct("category", "string", "group_by")).otherwise(as_struct("unknown", "string", None))
    )
    return fields.select("field", F.coalesce(told, by_value).alias("m")).select("field", "m.*")


@dataclass(frozen=True)
class Rule:
    """Names that a canonical field goes by: aliases as a whole, patterns as parts unless an exclusion is a part too."""

    aliases: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    exclusions: tuple[str, ...] = field(default=())


def canonical(name: Column, rules: Mapping[str, Rule]) -> Column:
    """The canonical name of a field: by an exact alias, by one in any case, by the first rule whose pattern it holds; else the name itself."""
    exact = {a: target for target, rule in reversed(rules.items()) for a in (target, *rule.aliases)}
    loose = {a.lower(): target for target, rule in reversed(rules.items()) for a in (target, *rule.aliases)}
    lookup = lambda m, k: F.try_element_at(F.create_map(*(F.lit(x) for pair in m.items() for x in pair)), k) if m else F.lit(None).cast("string")
    low = F.lower(name)
    holds = lambda parts: reduce(lambda a, b: a | b, (low.contains(p.lower()) for p in parts), F.lit(False))
    ruled = F.lit(None).cast("string")
    for target, rule in reversed(rules.items()):
        ruled = F.when(holds(rule.patterns) & ~holds(rule.exclusions), target).otherwise(ruled)
    return F.coalesce(lookup(exact, name), lookup(loose, low), ruled, name)


def renamed(data: Column, rules: Mapping[str, Rule]) -> Column:
    """A map of fields with canonical names. Of fields that get one name, the first in the map stays; a null map stays null."""
    entries = F.transform(F.map_entries(data), lambda e: F.struct(canonical(e["key"], rules).alias("key"), e["value"].alias("value")))
    firsts = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(firsts)


def active(registry: DataFrame, domain: str | None = None) -> DataFrame:
    """Schemas in use, of one domain if one is named."""
    rows = registry.where("is_active")
    return rows if domain is None else rows.where(F.col("domain") == domain)


def seeded(registry: DataFrame, seeds: DataFrame, update: bool = True) -> DataFrame:
    """The registry with seeds, one row for each schema_type: a seed replaces what is there, or gives way to it if update is false."""
    old, new = (registry, seeds) if update else (seeds, registry)
    every = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    row = F.struct(*(c for c in registry.columns if c != "schema_type"))
    return every.groupBy("schema_type").agg(F.max_by(row, "_turn").alias("row")).select("schema_type", "row.*").select(registry.columns)


def mapped(documents: DataFrame, registry: DataFrame, guessed: DataFrame) -> DataFrame:
    """documents with field_mappings and where they come from: a document's own, else its schema's, else the guess for its schema_type.

    documents has field_mappings (null if it has none of its own) and schema_type; registry and guessed have schema_type, once each, and field_mappings.
    """
    known = active(registry).select("schema_type", F.col("field_mappings").alias("_known"))
    guess = guessed.select("schema_type", F.col("field_mappings").alias("_guess"))
    source = F.when(F.col("field_mappings").isNotNull(), "document").when(F.col("_known").isNotNull(), "registry").when(F.col("_guess").isNotNull(), "inferred")
    rows = documents.join(known, "schema_type", "left").join(guess, "schema_type", "left").withColumn("mapping_source", source)
    return rows.withColumn("field_mappings", F.coalesce("field_mappings", "_known", "_guess")).drop("_known", "_guess")
