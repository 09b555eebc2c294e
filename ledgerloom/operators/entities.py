"""Organizations and persons named in texts and in the headers of records, one row for each in a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import entity_name

# What stands before or behind a name in a text, in the order of trust, and the header's fields.
_NAME = r"([A-Z][A-Za-z0-9\s.,&'-]+?)(?:\n|$|,)"
VENDOR_PATTERNS = (
    rf"(?im)(?:from|seller|vendor|supplier|billed\s+by|sold\s+by|merchant)[\s:]+{_NAME}",
    r"(?im)^([A-Z][A-Za-z0-9\s.,&'-]{2,50})\s+(?:invoice|receipt|statement|bill)",
    r"(?im)@([a-z0-9-]+)\.(?:com|org|net|io|co)",
)
CUSTOMER_PATTERNS = (
    rf"(?im)(?:to|customer|buyer|bill\s+to|ship\s+to|sold\s+to|client)[\s:]+{_NAME}",
    r"(?im)dear\s+([A-Z][A-Za-z\s]+?)[,\n]",
)
VENDOR_FIELDS = ("vendor_name", "seller_name", "merchant_name", "supplier_name", "company_name", "store_name")
CUSTOMER_FIELDS = ("customer_name", "buyer_name", "client_name", "bill_to", "ship_to")
CONFIDENCE = {"header": 0.95, "model": 0.85, "pattern": 0.7}
SHORTEST, LONGEST = 2, 100

ENTITY = "array<struct<kind:string,name:string,place:int>>"


def _listed(kind: str, found: list[Column]) -> Column:
    """Candidates of a kind as an array of (kind, name, place); place is the order in which they were found."""
    every = F.filter(F.transform(F.concat(*found), lambda n: F.trim(F.regexp_replace(n, r"^\s+|\s+$", ""))), lambda n: n.isNotNull() & F.length(n).between(SHORTEST, LONGEST))
    return F.transform(every, lambda n, i: F.struct(F.lit(kind).alias("kind"), n.alias("name"), i.alias("place"))).cast(ENTITY)


def _rows(documents: DataFrame, key: str, listed: Column, source: str) -> DataFrame:
    return documents.select(key, F.inline(listed)).select(key, "kind", "name", "place", F.lit(CONFIDENCE[source]).alias("confidence"), F.lit(source).alias("source"))


def in_text(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, name, place, confidence, source) of every name that a pattern finds in a text; a missing or empty text names nobody."""
    every = lambda patterns: [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in patterns]
    return _rows(documents, key, F.concat(_listed("organization", every(VENDOR_PATTERNS)), _listed("person", every(CUSTOMER_PATTERNS))), "pattern")


def in_header(documents: DataFrame, key: str, header: str) -> DataFrame:
    """The same of the fields of a header, a map of texts; fields that are missing name nobody."""
    every = lambda fields: [F.array(F.try_element_at(F.col(header), F.lit(f))) for f in fields]
    return _rows(documents, key, F.concat(_listed("organization", every(VENDOR_FIELDS)), _listed("person", every(CUSTOMER_FIELDS))), "header")


def merged(key: str, *found: DataFrame) -> DataFrame:
    """(key, kind, entity, name, confidence, source, is_primary): one row for each normal form of a name in a document, as its most trusted source writes it.

    The most trusted, then first found, entity of a kind is the document's primary one. Names without a normal form are left out. Rows of one document and name are folded in the
    tasks that find them, so a name that a text repeats often is shuffled once a task.
    """
    every = reduce(DataFrame.unionByName, found)
    form = F.when(F.col("kind") == "organization", entity_name(F.col("name"))).otherwise(entity_name(F.col("name"), False))
    trust = F.struct(F.col("confidence"), (-F.col("place")).alias("early"), F.col("name"), F.col("source"))
    one = every.withColumn("entity", form).where("entity <> ''").groupBy(key, "kind", "entity").agg(F.max(trust).alias("best"))
    rank = F.struct("best.confidence", "best.early", "best.name", "best.source", "entity")
    first = one.groupBy(key, "kind").agg(F.max(rank).alias("top")).select(F.col(key).alias("_key"), F.col("kind").alias("_kind"), F.col("top.entity").alias("_entity"))
    joined = one.join(first, one[key].eqNullSafe(first["_key"]) & (one["kind"] == first["_kind"]))
    return joined.select(key, "kind", "entity", "best.name", "best.confidence", "best.source", (F.col("entity") == F.col("_entity")).alias("is_primary"))
